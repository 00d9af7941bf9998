"""Rows that SQL has and an operator must not lose or alter: nulls, empty intervals, repeated rows, what doesn't vary."""

import math
import random

import pytest
from pyspark.sql import functions as F

from oracle import difference
from strandlake.operators import association, genetics
from strandlake.operators import intervals as iv
from strandlake.operators import repertoire as rp
from strandlake.plans import dag
from strandlake.plans.interval_queries import merged


def test_closure_has_no_limit_of_rows_or_depth(spark):
    line = spark.range(1, 131).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    got = {(r.node, r.ancestor): r.depth for r in dag.closure(spark, line).collect()}
    assert got == {(a, b): a - b for a in range(131) for b in range(a)}
    r = random.Random(2)
    edges = [(a, r.randrange(a)) for a in range(1, 60) for _ in range(2)]
    want = {}
    for a in range(60):
        for n, p in edges:
            if n == a:
                for b, d in [(p, 0), *((b, d) for (x, b), d in want.items() if x == p)]:
                    want[a, b] = min(want.get((a, b), 999), d + 1)
    got = {(x.node, x.ancestor): x.depth for x in dag.closure(spark, spark.createDataFrame([*edges, (7, None)], "node long, parent long")).collect()}
    assert got == want
    with pytest.raises(ValueError, match="cycle"):
        dag.closure(spark, spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))


def test_what_does_not_vary_has_no_correlation(spark):
    # Variants 1 and 2 share samples over which 1 is constant; 9 has no neighbour.
    rows = [(1, 1, 0), (2, 1, 0), (3, 1, 2), (1, 2, 0), (2, 2, 1), (3, 3, 1), (4, 3, 0), (1, 3, 2), (5, 9000, 1)]
    df = spark.createDataFrame(rows, "sample long, snp long, dosage int")
    r2 = {(x.a, x.b): x.r2 for x in genetics.linkage(df, 400).collect()}
    assert math.isnan(r2[1, 2]) and r2[1, 3] == pytest.approx(1.0)
    got = {x.snp: x.ld_score for x in association.ld_scores(df, 400).collect()}
    assert math.isnan(got[1]) and math.isnan(got[2]) and got[9000] == 1.0


def test_merge_intervals_of_odd_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(40)] * 3 + [r.randint(0, 300_000)]), r.choice([None, 0, 1, 3, -2])) for _ in range(300)]
    rows = [(c, a, None if a is None or n is None else a + n) for c, a, n in rows] + [("a", 500, 510)] * 20 + [("a", 500, 500)] * 3 + [("b", None, 7)]
    df = spark.createDataFrame(rows, "chrom string, start long, stop long").repartition(5)
    con = duckdb.connect()
    con.register("t", df.toArrow())
    sql = merged("t", "start", "stop", 0)
    assert difference(iv.merge_intervals(df), con, f"SELECT chrom, start, stop FROM ({sql})") is None
    assert difference(iv.islands(df, "start", "stop", 0), con, sql) is None


def test_visit_summary_of_persons_without_records(spark):
    person = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y"), (4, "y"), (None, "z")], "id long, place string")
    records = spark.createDataFrame([(1, "O"), (1, "F"), (1, "F"), (3, None), (4, "O"), (2, "P"), (None, "O"), (9, "O")], "id long, kind string")
    got = {tuple(r) for r in rp.visit_summary(person, records, "id", F.col("kind") == "O", F.col("kind") == "F").collect()}
    assert got == {(1, "x", 1, 2), (2, "x", 0, 0), (3, None, None, None), (4, "y", 2, 0), (None, "z", None, None)}
