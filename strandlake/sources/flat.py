"""Readers and writers of flat files. Text formats are parsed by Spark's own text reader, so they split and push down.

Records that span lines are read with a record separator in place of the line separator, which keeps files splittable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the formats.
BLAST_COLUMNS = "query subject identity length mismatches gap_opens q_start q_end s_start s_end evalue bitscore".split()
MAF_COLUMNS = "Hugo_Symbol Tumor_Sample_Barcode Variant_Classification Variant_Type Chromosome Start_Position End_Position Reference_Allele Tumor_Seq_Allele2".split()
ALIASES = {"chrom": ("chr", "chrom", "chromosome"), "lo": ("start", "left", "begin"), "hi": ("end", "stop", "right")}


def _missing(c: Column) -> Column:
    return F.nullif(c, F.lit("."))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """identifier, description, sequence (upper case, lines joined)."""
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "\r", "").alias("b"))
    # The separator takes the > of all records but a file's first.
    whole = rows.where(F.trim("b") != "").withColumn("b", F.regexp_replace("b", r"^\s*>", ""))
    name = F.substring_index("b", "\n", 1)
    seq = F.upper(F.regexp_replace(F.when(F.instr("b", "\n") > 0, F.expr("substring(b, instr(b, '\n') + 1)")).otherwise(""), r"\s", ""))
    return whole.select(F.regexp_extract(name, r"^(\S*)", 1).alias("identifier"), name.alias("description"), seq.alias("sequence"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    lines = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col("description"), F.lit("\n"), lines)).write.mode("overwrite").text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), F.col("description"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality"))).write.mode("overwrite").text(path)


def _fields(spark: SparkSession, path: str, least: int, sep: str = "\t") -> DataFrame:
    """Split lines without comments; lines of fewer fields are skipped."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.split(F.regexp_replace("value", "\r$", ""), sep).alias("f")).where(F.size("f") >= least)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual (. is null), filter, info, format, samples. Lines of under six fields are skipped; pos must be positive."""
    f = _fields(spark, path, 6)
    at = lambda i: F.try_element_at("f", F.lit(i + 1))
    pos = at(1).cast("long")
    return f.select(
        at(0).alias("chrom"), F.when(pos > 0, pos).otherwise(F.raise_error(F.lit("POS must be positive"))).alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"),
        _missing(at(5)).cast("float").alias("qual"), at(6).alias("filter"), at(7).alias("info"), at(8).alias("format"), F.slice("f", 10, 1 << 20).alias("samples"),
    )


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """One row: meta lines and sample names."""
    rows = spark.read.text(path).where(F.col("value").startswith("#"))
    meta = F.collect_list(F.when(F.col("value").startswith("##"), F.col("value")))
    names = F.max(F.when(F.col("value").startswith("#CHROM"), F.slice(F.split("value", "\t"), 10, 1 << 20)))
    return rows.agg(F.array_sort(meta).alias("meta"), names.alias("samples"))


def write_vcf(df: DataFrame, path: str) -> None:
    """The file's header, then the rows in the order of their partitions; the header goes into a part of its own that sorts first."""
    spark = df.sparkSession
    cols = [F.col("chrom"), F.col("pos").cast("string"), F.col("id"), F.col("ref"), F.col("alt"), F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.coalesce("filter", F.lit(".")), F.coalesce("info", F.lit("."))]
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",)], "value string").coalesce(1)
    head.union(df.select(F.concat_ws("\t", *cols).alias("value"))).write.mode("overwrite").text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, stop (0-based, half-open) and the other fields; start must not be negative, nor stop at or before start."""
    f = _fields(spark, path, 3)
    start, stop = F.element_at("f", 2).cast("long"), F.element_at("f", 3).cast("long")
    ok = F.when((start >= 0) & (stop > start), start).otherwise(F.raise_error(F.lit("an interval needs 0 <= start < stop")))
    return f.select(F.element_at("f", 1).alias("chrom"), ok.alias("start"), stop.alias("stop"), F.slice("f", 4, 1 << 20).alias("rest"))


def write_bed(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"))).write.mode("overwrite").text(path)


def bed_to_ranges(df: DataFrame) -> DataFrame:
    """0-based half-open to 1-based closed."""
    return df.select("chrom", (F.col("start") + 1).alias("lo"), F.col("stop").alias("hi"), F.lit(".").alias("strand"))


def gff_attributes(text: Column) -> Column:
    """map<string, array<string>> of key=value,value;… with percent escapes decoded."""
    pairs = F.filter(F.transform(F.split(text, ";"), lambda p: F.split(F.trim(p), "=", 2)), lambda p: F.size(p) == 2)
    entry = lambda p: F.struct(p[0].alias("key"), F.transform(F.split(p[1], ","), F.url_decode).alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns; . is null; 1-based closed; strand is one of + - . ?, phase 0, 1 or 2."""
    f = _fields(spark, path, 9)
    at = lambda i: F.element_at("f", i + 1)
    strand = F.when(at(6).isin("+", "-", ".", "?"), at(6)).otherwise(F.raise_error(F.lit("unknown strand")))
    phase = _missing(at(7)).cast("int")
    return f.select(
        at(0).alias("chrom"), at(1).alias("source"), at(2).alias("type"), at(3).cast("long").alias("lo"), at(4).cast("long").alias("hi"), _missing(at(5)).cast("double").alias("score"),
        strand.alias("strand"), F.when(phase.isNull() | phase.between(0, 2), phase).otherwise(F.raise_error(F.lit("phase is 0, 1 or 2"))).alias("phase"), gff_attributes(at(8)).alias("attributes"),
    )


def write_gff(df: DataFrame, path: str) -> None:
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], F.url_encode), ","))), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    df.select(F.concat_ws("\t", "chrom", "source", "type", F.col("lo").cast("string"), F.col("hi").cast("string"), dot("score"), "strand", dot("phase"), attrs)).write.mode("overwrite").text(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; chrom, lo, hi, strand by their usual names, all other columns in a map."""
    raw = spark.read.csv(path, header=True)
    lower = {c.lower(): c for c in raw.columns}
    named = {}
    for name, options in ALIASES.items():
        found = [lower[o] for o in options if o in lower]
        if not found:
            raise ValueError(f"no column for {name}: one of {', '.join(options)} is needed")
        named[name] = found[0]
    strand = F.coalesce(F.col(lower["strand"]), F.lit(".")) if "strand" in lower else F.lit(".")
    rest = [c for c in raw.columns if c not in named.values() and c.lower() != "strand"]
    meta = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]) if rest else F.expr("cast(map() as map<string, string>)")
    return raw.select(F.col(named["chrom"]).alias("chrom"), F.col(named["lo"]).cast("long").alias("lo"), F.col(named["hi"]).cast("long").alias("hi"), strand.alias("strand"), meta.alias("metadata"))


def read_blast_tabular(spark: SparkSession, path: str) -> DataFrame:
    kinds = ["string", "string", "double", *["long"] * 7, "double", "double"]
    return spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{n} {k}" for n, k in zip(BLAST_COLUMNS, kinds, strict=True)))


def read_blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each aligned segment of a BLAST XML report."""
    rows = spark.read.format("xml").option("rowTag", "Hit").schema("Hit_id string, Hit_def string, Hit_len long, Hit_hsps struct<Hsp: array<struct<`Hsp_bit-score`: double, Hsp_evalue: double, `Hsp_query-from`: long, `Hsp_query-to`: long, `Hsp_hit-from`: long, `Hsp_hit-to`: long, Hsp_identity: long, `Hsp_align-len`: long>>>").load(path)
    h = F.col("h")
    return rows.select("Hit_id", "Hit_def", "Hit_len", F.explode("Hit_hsps.Hsp").alias("h")).select(
        F.col("Hit_id").alias("subject"), F.col("Hit_def").alias("definition"), F.col("Hit_len").alias("subject_length"), h["Hsp_bit-score"].alias("bitscore"), h["Hsp_evalue"].alias("evalue"),
        h["Hsp_query-from"].alias("q_start"), h["Hsp_query-to"].alias("q_end"), h["Hsp_hit-from"].alias("s_start"), h["Hsp_hit-to"].alias("s_end"), h["Hsp_identity"].alias("identical"), h["Hsp_align-len"].alias("length"),
    )


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", comment="#", header=True)
    lost = [c for c in MAF_COLUMNS if c not in raw.columns]
    if lost:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    return raw.select(*[F.col(c).cast("long").alias(c) if c.endswith("_Position") else F.col(c) for c in MAF_COLUMNS])


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """locus, accession, definition, organism, features (array of key, location, qualifiers text), sequence; a record ends with //."""
    rows = spark.read.text(path, lineSep="\n//").where(F.contains("value", F.lit("LOCUS")))
    v = F.regexp_replace("value", "\r", "")
    line = lambda key: F.trim(F.regexp_replace(F.regexp_extract(v, rf"(?m)^{key}\s+(.*(?:\n {{12}}.*)*)", 1), r"\s+", " "))
    table = F.regexp_extract(v, r"(?s)\nFEATURES[^\n]*\n(.*?)\nORIGIN", 1)
    blocks = F.regexp_extract_all(F.concat(F.lit("\n"), table), F.lit(r"\n {5}(\S[^\n]*(?:\n {21}[^\n]*)*)"), F.lit(1))
    part = lambda b: F.struct(F.regexp_extract(b, r"^(\S+)", 1).alias("key"), F.regexp_replace(F.regexp_extract(b, r"^\S+\s+([^/]*)", 1), r"\s", "").alias("location"), F.regexp_extract(b, r"(?s)(/.*)$", 1).alias("qualifiers"))
    seq = F.upper(F.regexp_replace(F.regexp_extract(v, r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\s0-9]", ""))
    return rows.select(F.regexp_extract(v, r"LOCUS\s+(\S+)", 1).alias("locus"), line("ACCESSION").alias("accession"), line("DEFINITION").alias("definition"), line(" {2}ORGANISM").alias("organism"), F.transform(blocks, part).alias("features"), seq.alias("sequence"))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms by the format's fixed columns."""
    v = spark.read.text(path).where(F.col("value").rlike("^(ATOM  |HETATM)"))
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    return v.select(
        cut(1, 6).alias("record"), cut(7, 5).cast("int").alias("serial"), cut(13, 4).alias("atom"), cut(18, 3).alias("residue"), cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("resseq"),
        cut(31, 8).cast("double").alias("x"), cut(39, 8).cast("double").alias("y"), cut(47, 8).cast("double").alias("z"), cut(77, 2).alias("element"),
    )


def read_medline(spark: SparkSession, path: str) -> DataFrame:
    """pmid and a map of each field's values; records are apart by an empty line, and a field may go on in indented lines."""
    rows = spark.read.text(path, lineSep="\n\n").where(F.contains("value", F.lit("PMID")))
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n {6}", " ")
    pairs = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(F.trim(F.substring(x, 1, 4)).alias("k"), F.trim(F.substring(x, 7, 1 << 20)).alias("v"))), lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    fields = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))
    return rows.select(F.regexp_extract(text, r"(?m)^PMID\s*-\s*(\d+)", 1).alias("pmid"), fields.alias("fields"))


def write_bedgraph(df: DataFrame, path: str) -> None:
    """Runs (chrom, start, stop, value) as text, by chromosome and start."""
    df.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), F.col("value").cast("string"))).write.mode("overwrite").text(path)
