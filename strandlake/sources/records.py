"""More flat formats: indexed FASTA, EMBL, SwissProt, mmCIF atoms, multiple alignments, motif matrices and trees.

Records are read whole by a record separator, so files split; only an index is read a file at a time, as byte ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of an index file's columns, and of the atoms' columns here by those of the format.
FAI = "name string, length long, offset long, line_bases long, line_width long"
ATOM_SITE = {"group_PDB": "record", "id": "id", "label_atom_id": "atom", "label_comp_id": "residue", "auth_asym_id": "chain", "auth_seq_id": "resseq", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "B_iso_or_equiv": "bfactor"}


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, offset, line_bases, line_width) of each record, from one pass over each file's bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for where, content in zip(f["path"], f["content"], strict=True):
                at, now = 0, None
                for line in bytes(content).split(b"\n"):
                    bare = line.rstrip(b"\r")
                    if bare.startswith(b">"):
                        now = [where, (bare[1:].split() or [b""])[0].decode(), 0, at + len(line) + 1, 0, 0]
                        rows.append(now)
                    elif now is not None and bare:
                        if not now[4]:
                            now[4], now[5] = len(bare), len(line) + 1
                        now[2] += len(bare)
                    at += len(line) + 1
            yield pd.DataFrame(rows, columns=["path", *[x.split()[0] for x in FAI.split(", ")]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {FAI}")


def fetch_fasta(index: DataFrame, regions: DataFrame) -> DataFrame:
    """(columns of regions, sequence) of regions (name, start, stop; 0-based, half-open): each task reads only the bytes it needs.

    index comes from fasta_index; its files must be readable by path from every task.
    """
    wanted = regions.join(index, "name").withColumn("stop", F.least("stop", "length")).where("start < stop")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in regions.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            out = []
            for path, part in f.groupby("path"):
                system, where = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///"))
                with system.open_input_file(where) as file:
                    for r in part.itertuples():
                        byte = lambda p, r=r: r.offset + p // r.line_bases * r.line_width + p % r.line_bases
                        file.seek(byte(r.start))
                        out.append(b"".join(file.read(byte(r.stop - 1) + 1 - byte(r.start)).split()).decode())
                yield part.assign(sequence=out)[[*names, "sequence"]]
                out = []

    names = regions.columns
    return wanted.mapInPandas(run, f"{kinds}, sequence string")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, lineSep="\n//").select(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\n+", "").alias("b"))
    return rows.where(F.trim("b") != "")


def _line(tag: str, pattern: str = r"(.*)"):
    return F.regexp_extract("b", rf"(?m)^{tag}   {pattern}$", 1)


def _after(tag: str):
    """Letters of the sequence block, without numbers and spaces."""
    return F.upper(F.regexp_replace(F.regexp_extract("b", rf"(?s)\n{tag}   [^\n]*\n(.*)$", 1), r"[\s0-9]", ""))


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """accession, description, organism, sequence."""
    return _entries(spark, path).select(_line("AC", r"([^;\s]+).*").alias("accession"), F.array_join(F.regexp_extract_all("b", F.lit(r"(?m)^DE   (.*)$"), 1), " ").alias("description"), _line("OS").alias("organism"), _after("SQ").alias("sequence"))


def read_swissprot(spark: SparkSession, path: str) -> DataFrame:
    """entry, accession, name, gene, organism, taxon, sequence."""
    return _entries(spark, path).select(
        F.regexp_extract("b", r"(?m)^ID   (\S+)", 1).alias("entry"), _line("AC", r"([^;\s]+).*").alias("accession"), F.regexp_extract("b", r"RecName: Full=([^;{\n]+?)\s*[;{\n]", 1).alias("name"),
        F.regexp_extract("b", r"(?m)^GN   Name=([^;{\s]+)", 1).alias("gene"), F.regexp_replace(_line("OS"), r"\.$", "").alias("organism"), F.regexp_extract("b", r"NCBI_TaxID=(\d+)", 1).alias("taxon"), _after("SQ").alias("sequence"),
    )


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms: record, id, atom, residue, chain, resseq, x, y, z, bfactor, and the file's path. A file's atom table follows its column names, so a file is one row."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("b"))
    names = F.regexp_extract_all("b", F.lit(r"(?m)^_atom_site\.(\S+)"), 1)
    body = F.regexp_extract("b", r"(?s)_atom_site\.\S+[ \t]*\n((?:(?:ATOM|HETATM)[^\n]*\n?)+)", 1)
    lines = rows.select("path", names.alias("names"), F.explode(F.split(body, "\n")).alias("l")).where(F.trim("l") != "").withColumn("f", F.split(F.trim("l"), r"\s+"))
    field = lambda c: F.regexp_replace(F.get("f", F.array_position("names", c).cast("int") - 1), "^[\"']|[\"']$", "")
    kinds = {"id": "long", "resseq": "long", "x": "double", "y": "double", "z": "double", "bfactor": "double"}
    return lines.select("path", *[field(c).cast(kinds.get(n, "string")).alias(n) for c, n in ATOM_SITE.items()])


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, sequence): blocks of a name are joined in their order."""
    lines = _numbered(spark, path).where(~F.col("l").rlike(r"^(CLUSTAL|MUSCLE|\s)") & (F.trim("l") != ""))
    return _joined(lines, r"^(\S+)\s+(\S+)")


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    return _joined(_numbered(spark, path).where(~F.col("l").rlike(r"^(#|//)") & (F.trim("l") != "")), r"^(\S+)\s+(\S+)")


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """Sequential, names without spaces."""
    return _joined(_numbered(spark, path).where((F.col("no") > 0) & (F.trim("l") != "")).withColumn("l", F.regexp_replace(F.trim("l"), r"(?<=\S)\s+(?=\S+\s)", " ")), r"^(\S+)\s+(.+)")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("b"))
    return rows.select("path", F.posexplode(F.split("b", "\n")).alias("no", "l"))


def _joined(lines: DataFrame, pattern: str) -> DataFrame:
    parts = lines.select("path", "no", F.regexp_extract("l", pattern, 1).alias("name"), F.regexp_replace(F.regexp_extract("l", pattern, 2), r"\s", "").alias("part"))
    return parts.groupBy("path", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda s: s["part"]), "").alias("sequence"))


def alignment_text(rows: list[tuple[str, str]], kind: str, width: int = 60) -> str:
    """One alignment, (name, sequence) in order, as fasta, clustal, stockholm or phylip."""
    longest = max((len(n) for n, _ in rows), default=0) + 2
    size = len(rows[0][1]) if rows else 0
    if kind == "fasta":
        return "".join(f">{n}\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for n, s in rows)
    if kind == "phylip":
        return f"{len(rows)} {size}\n" + "".join(f"{n.ljust(longest)}{s}\n" for n, s in rows)
    if kind == "stockholm":
        return "# STOCKHOLM 1.0\n" + "".join(f"{n.ljust(longest)}{s}\n" for n, s in rows) + "//\n"
    if kind == "clustal":
        blocks = ["".join(f"{n.ljust(longest)}{s[i : i + width]}\n" for n, s in rows) for i in range(0, size, width)]
        return "CLUSTAL multiple sequence alignment\n\n" + "\n".join(blocks)
    raise ValueError(f"{kind} is no alignment format")


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """(motif, pos, A, C, G, T) from the letter-probability matrices."""
    blocks = spark.read.text(path, lineSep="\nMOTIF ").select(F.regexp_replace("value", "\r", "").alias("b")).where(F.col("b").contains("letter-probability matrix"))
    body = F.regexp_extract("b", r"(?s)letter-probability matrix[^\n]*\n((?:[ \t]*[0-9][^\n]*\n?)+)", 1)
    rows = blocks.select(F.regexp_extract("b", r"^(\S+)", 1).alias("motif"), F.posexplode(F.split(F.rtrim(F.regexp_replace(body, r"\n+$", "")), "\n")).alias("pos", "l"))
    f = F.split(F.trim("l"), r"\s+")
    return rows.select("motif", (F.col("pos") + 1).alias("pos"), *[F.get(f, F.lit(k)).cast("double").alias(b) for k, b in enumerate("ACGT")])


def read_nexus_trees(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, newick) of the TREES block; names of a TRANSLATE table are put in by readers of the text if they need them."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"(?i)^\s*u?tree\s+"))
    return lines.select(F.regexp_extract("value", r"(?i)^\s*u?tree\s+\*?\s*([^=\s]+)", 1).alias("tree_id"), F.regexp_replace(F.regexp_extract("value", r"=\s*(.*)$", 1), r"\[[^\]]*\]\s*", "").alias("newick"))
