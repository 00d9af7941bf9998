"""Motif matrices, population genotypes and classification tables, read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jaspar(spark: SparkSession, path: str) -> DataFrame:
    """A row for each place and letter of each matrix: matrix, name, pos, sym, n. Rows of letters with or without brackets."""
    rows = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    head = F.split(F.substring_index(body, "\n", 1), r"\s+")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*[ACGT]\s"))
    counts = lambda x: F.filter(F.split(F.regexp_replace(F.substring(F.trim(x), 2, 1 << 20), r"[\[\]]", " "), r"\s+"), lambda v: v != "")
    out = rows.select(head[0].alias("matrix"), F.coalesce(F.try_element_at(head, F.lit(2)), head[0]).alias("name"), F.explode(F.transform(lines, lambda x: F.struct(F.substring(F.trim(x), 1, 1).alias("sym"), counts(x).alias("v")))).alias("s"))
    return out.select("matrix", "name", "s.sym", F.posexplode("s.v").alias("pos", "n")).select("matrix", "name", (F.col("pos") + 1).alias("pos"), "sym", F.col("n").cast("double").alias("n"))


def read_genepop(spark: SparkSession, path: str) -> DataFrame:
    """pop (from 1), individual, locus (from 1), alleles (null where missing) of one file a row of text; lines after each Pop are individuals."""
    rows = spark.read.text(path, wholetext=True)
    parts = F.split(F.regexp_replace("value", "\r", ""), r"(?im)^\s*pop\s*$")
    pops = rows.select(F.posexplode(F.slice(parts, 2, 1 << 20)).alias("pop", "text"))
    people = pops.select((F.col("pop") + 1).alias("pop"), F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit(",")))
    codes = F.filter(F.split(F.substring_index("line", ",", -1), r"\s+"), lambda c: c != "")
    half = lambda c: F.floor(F.length(c) / 2).cast("int")
    loci = people.select("pop", F.trim(F.substring_index("line", ",", 1)).alias("individual"), F.posexplode(codes).alias("locus", "code"))
    a, b = F.substring("code", F.lit(1), half(F.col("code"))).cast("int"), F.substring("code", half(F.col("code")) + 1, half(F.col("code"))).cast("int")
    return loci.select("pop", "individual", (F.col("locus") + 1).alias("locus"), F.when((a > 0) & (b > 0), F.array(a, b)).alias("alleles"))


def read_scop(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 6)
    at = lambda i: F.element_at("f", i + 1)
    ids = F.transform(F.split(at(5), ","), lambda p: F.struct(F.split(p, "=")[0].alias("key"), F.split(p, "=")[1].alias("value")))
    return f.select(at(0).alias("sid"), at(1).alias("pdb"), at(2).alias("region"), at(3).alias("sccs"), at(4).cast("long").alias("sunid"), F.map_from_entries(ids).alias("hierarchy"))


def read_cath(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 12)
    at = lambda i: F.element_at("f", i + 1)
    return f.select(at(0).alias("domain"), F.concat_ws(".", *[at(i) for i in range(1, 5)]).alias("superfamily"), at(10).cast("int").alias("length"), at(11).cast("double").alias("resolution"))


def read_kegg(spark: SparkSession, path: str) -> DataFrame:
    """entry, name, class, and the gene ids and names of flat records that end with ///."""
    rows = spark.read.text(path, lineSep="\n///").where(F.contains("value", F.lit("ENTRY")))
    v = F.regexp_replace("value", "\r", "")
    one = lambda k: F.trim(F.regexp_extract(v, rf"(?m)^{k}\s+(.*)$", 1))
    block = F.regexp_extract(v, r"(?m)^GENE\s+((?:.*\n?)(?:^\s+.*\n?)*)", 1)
    genes = F.transform(F.filter(F.split(block, "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.regexp_extract(F.trim(x), r"^(\S+)", 1).alias("id"), F.regexp_extract(F.trim(x), r"^\S+\s+([^;\[]*)", 1).alias("name")))
    return rows.select(F.regexp_extract(v, r"ENTRY\s+(\S+)", 1).alias("entry"), one("NAME").alias("name"), one("CLASS").alias("class"), genes.alias("genes"))


def read_bismark(spark: SparkSession, path: str) -> DataFrame:
    """chrom, lo, hi, level, methylated, unmethylated; shorter lines are skipped."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 6)
    at = lambda i: F.element_at("f", i + 1)
    m, u = at(4).cast("long"), at(5).cast("long")
    return f.select(at(0).alias("chrom"), at(1).cast("long").alias("lo"), at(2).cast("long").alias("hi"), F.when(m + u > 0, m / (m + u)).alias("level"), m.alias("methylated"), u.alias("unmethylated"))
