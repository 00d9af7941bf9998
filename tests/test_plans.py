"""What plans must show: filters and columns at the scan, no cross joins, no Python where none is needed."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.operators import intervals as iv
from strandlake.operators import repertoire as rp


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def variants(spark, tmp_path):
    df = spark.range(1000).select(
        F.concat(F.lit("chr"), (F.col("id") % 5).cast("string")).alias("chrom"), F.col("id").alias("pos"), F.col("id").cast("string").alias("id"),
        F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit(1.0).alias("qual"), F.lit("unused").alias("other"),
    )
    df.write.parquet(str(tmp_path / "v"))
    return spark.read.parquet(str(tmp_path / "v"))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    v = variants(spark, tmp_path)
    text = plan(iv.filter_region(v, "chr1", 10, 20))
    assert "EqualTo(chrom,chr1)" in text and "GreaterThanOrEqual(pos,10)" in text and "LessThanOrEqual(pos,20)" in text and "other" not in re.search(r"ReadSchema: (.*)", text)[1]
    counts = plan(iv.bin_positions(v, 10))
    assert re.search(r"ReadSchema: struct<pos:bigint>", counts) and counts.count("Exchange") and "Python" not in counts


def test_range_join_is_an_equi_join(spark):
    a = spark.createDataFrame([("c", 1, 5, "+")], "chrom string, lo long, hi long, strand string")
    text = plan(iv.find_overlaps(a, a))
    assert "NestedLoop" not in text and "Cartesian" not in text and "EvalPython" not in text and "MapIn" not in text


def test_aggregates_are_partial_first(spark):
    df = spark.createDataFrame([("a", "s", 1)], "clone string, sample string, v int")
    text = plan(rp.clonotype_table(df, by=("sample",)))
    assert "partial_count" in text and "Window" not in text


def test_kmers_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "ACGT")], "k long, seq string")
    assert "EvalPython" not in plan(sq.kmer_counts(df, "seq", 3)) and sq.kmer_counts(df, "seq", 3).count() == 2
    long = spark.createDataFrame([(1, "ACGTT" * 1000)], "k long, seq string")
    for spread in (False, True):
        got = {r.kmer: r.n for r in sq.kmer_counts(long, "seq", 4, spread=spread).collect()}
        text = "ACGTT" * 1000
        assert sum(got.values()) == len(text) - 3 and got["ACGT"] == 1000 and got["TTAC"] == 999
