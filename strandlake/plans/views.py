"""Domain views over the driver's tables, written so that Spark and DuckDB read them alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Name -> SELECT over the tables (or views above it). Integers stay BIGINT and division is floor(a / b).
VIEWS = {
    # 0-based half-open intervals
    "intervals": "SELECT 'chr' || CAST(l_suppkey % 22 + 1 AS STRING) AS chrom, l_partkey * 10 + l_linenumber AS start, l_partkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS stop, CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand FROM lineitem",
    # 1-based closed intervals, one row each
    "ranges": "SELECT DISTINCT chrom, start + 1 AS lo, stop AS hi, strand FROM intervals",
    "genes": "SELECT 'chr' || CAST(p_partkey % 22 + 1 AS STRING) AS chrom, p_partkey * 10 AS start, p_partkey * 10 + p_size * 5 AS stop, p_name || '-' || CAST(p_partkey AS STRING) AS name, p_partkey AS gene_id, CASE p_size % 2 WHEN 0 THEN '+' ELSE '-' END AS strand, p_type AS kind FROM part",
    "variants": "SELECT 'chr' || CAST(user_id % 22 + 1 AS STRING) AS chrom, event_id % 20000 + 1 AS pos, 'rs' || CAST(event_id AS STRING) AS id, substring('ACGT', CAST(event_id % 4 + 1 AS INT), 1) AS ref, substring('ACGT', CAST((event_id % 4 + 1 + CAST(floor(event_id / 4) AS BIGINT) % 3) % 4 + 1 AS INT), 1) AS alt, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS qual, event_id, user_id, event_type FROM events",
    "dna": "SELECT doc_id, {letters_only} AS seq FROM documents",
    # Reads of 60 letters that whole sequences are cut into, the last of each as long as it is; pieces are rows of an alignment
    "reads": "SELECT doc_id * 1000000 + i AS doc_id, substring(seq, 60 * i + 1, 60) AS seq FROM (SELECT doc_id, seq, {sixties} AS i FROM dna WHERE length(seq) > 0)",
    "pieces": "SELECT doc_id, seq FROM reads WHERE length(seq) = 60",
    "counts": "SELECT p_brand AS gene, n_name AS sample, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS count FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY p_brand, n_name",
    "clonotypes": "SELECT user_id AS clone, event_type AS sample, CAST(floor((extract(day FROM ts) - 1) / 7) AS BIGINT) AS timepoint, value FROM events",
    "survival": "SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 500 + 1 AS time, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS status, c_mktsegment AS grp FROM orders JOIN customer ON o_custkey = c_custkey",
    "genotypes": "SELECT sample, snp, c_nationkey AS pop, CASE WHEN (sample + snp) % 17 = 0 THEN NULL ELSE (7 * sample + 13 * snp + sample * snp % 5) % 3 END AS dosage FROM (SELECT DISTINCT o_custkey AS sample, l_suppkey AS snp FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN customer ON sample = c_custkey",
    "genesets": "SELECT r_name AS term, n_name AS gene FROM nation JOIN region ON n_regionkey = r_regionkey",
    "atoms": "SELECT p_partkey % 3 AS structure, substring('ABCD', CAST(p_partkey % 4 + 1 AS INT), 1) AS chain, CAST(floor(p_partkey / 20) AS BIGINT) AS resseq, CASE CAST(floor(p_partkey / 4) AS BIGINT) % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' WHEN 3 THEN 'O' ELSE 'SG' END AS atom, CASE p_size % 4 WHEN 0 THEN 'CYS' WHEN 1 THEN 'ALA' WHEN 2 THEN 'GLY' ELSE 'LYS' END AS residue, CAST(p_partkey * 7 % 101 AS DOUBLE) / 2 AS x, CAST(p_partkey * 13 % 97 AS DOUBLE) / 2 AS y, CAST(p_partkey * 29 % 89 AS DOUBLE) / 2 AS z, p_retailprice / 100 AS bfactor, p_partkey AS id FROM part",
    "spots": "SELECT c_custkey AS spot, c_custkey % 40 AS x, CAST(floor(c_custkey / 40) AS BIGINT) AS y, c_acctbal AS value, c_mktsegment AS label FROM customer",
    "expression": "SELECT l_orderkey AS cell, p_brand AS gene, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n, max(l_returnflag) AS cond FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand",
    "peptides": "SELECT p_brand AS protein, s_nationkey AS sample, l_extendedprice AS intensity, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey",
}
LETTERS = {"spark": "regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '')", "duckdb": "regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g')"}


SIXTIES = {"spark": "explode(sequence(0, CAST(floor((length(seq) - 1) / 60) AS INT)))", "duckdb": "unnest(range(0, CAST(floor((length(seq) - 1) / 60) AS BIGINT) + 1))"}
#: A scan of fewer bytes a core than this is dealt out before texts are worked on: a small file may be one row group.
SMALL_SCAN = 32 << 20


def _needed(sql: str) -> list[str]:
    """Views that a SELECT uses, directly or not, each behind those it uses itself."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql, re.I):
            out += [x for x in [*_needed(VIEWS[name]), name] if x not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, f"SELECT * FROM {name}")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a SELECT over views and tables of a folder; leaves no view behind in the session's catalog."""
    whole = with_views(sql, "spark")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", whole)]
    for t in used:
        whole = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", whole, flags=re.I)
    return spark.sql(whole, **{t: _table(spark, sf_dir, t) for t in used})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with all its columns (those a plan doesn't use are pruned at the scan); texts of a small one are dealt out to all cores, a large one has partitions enough."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "documents":
        return df
    cores = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SMALL_SCAN
    return df.repartition(cores) if small and cores > 1 else df


def with_views(sql: str, engine: str) -> str:
    """The SELECT with the views it uses as common table expressions."""
    needed = _needed(sql)
    if not needed:
        return sql
    heads = ", ".join(f"{n} AS ({VIEWS[n].replace('{letters_only}', LETTERS[engine]).replace('{sixties}', SIXTIES[engine])})" for n in needed)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {sql}"


def duck(sql: str) -> str:
    return with_views(sql, "duckdb")
