"""Neighbours, sums and maxima found bin by bin are those of the whole partition."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import intervals as iv
from strandlake.operators import signals
from strandlake.operators.running import neighbour


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour(spark, width, ahead):
    r = random.Random(width)
    rows = [(r.choice(["a", "b", None]), p, r.choice([None, 1, 2, 3])) for p in r.sample(range(-200, 400), 150)]
    df = spark.createDataFrame(rows, "chrom string, pos long, v int")
    got = {(x.chrom, x.pos): x.n for x in neighbour(df, ["chrom"], "pos", ["pos"], F.col("v"), "n", ahead, bin_width=width).collect()}
    want = {}
    for c in ("a", "b", None):
        line = sorted(((p, v) for k, p, v in rows if k == c), key=lambda x: x[0])
        for i, (p, _) in enumerate(line):
            j = i + 1 if ahead else i - 1
            want[c, p] = line[j][1] if 0 <= j < len(line) else None
    assert got == want


def test_neighbour_of_nothing(spark):
    df = spark.createDataFrame([], "chrom string, pos long")
    assert neighbour(df, ["chrom"], "pos", ["pos"], F.col("pos"), "n", True).count() == 0


def test_coverage_and_pieces_over_bins(spark):
    r = random.Random(4)
    spans = [(lo, lo + r.randint(0, 90_000)) for lo in (r.randint(1, 400_000) for _ in range(40))]
    df = spark.createDataFrame([("c", lo, hi, "+") for lo, hi in spans], "chrom string, lo long, hi long, strand string")
    cuts = sorted({x for lo, hi in spans for x in (lo, hi + 1)})
    depth = {(a, b - 1): sum(lo <= a and hi >= b - 1 for lo, hi in spans) for a, b in zip(cuts, cuts[1:])}
    assert sum((x.hi - x.lo + 1) * x.depth for x in iv.coverage(df).collect()) == sum(hi - lo + 1 for lo, hi in spans)
    assert {(x.lo, x.hi) for x in iv.disjoin(df).collect()} == {k for k, n in depth.items() if n}


def test_runs_and_minima_over_bins(spark):
    df = spark.range(200_000).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"), F.floor(F.col("id") / 50_000).alias("v"))
    got = sorted((x.start, x.stop, x.v) for x in iv.run_length(df, ("chrom",), "pos", "v").collect())
    assert got == [(k * 50_000, (k + 1) * 50_000, k) for k in range(4)]
    valley = spark.range(100_000).select(F.lit("c").alias("chrom"), F.col("id").alias("pos"), F.abs(F.col("id") - 65_536).alias("v"))
    assert [x.pos for x in signals.boundaries(valley, ["chrom"], "pos", "v").collect()] == [65_536]
