"""Pairs of sequences and of ranges against brute force."""

import random

import pytest

from strandlake.operators import intervals as iv
from strandlake.operators import kernels
from strandlake.operators import repertoire as rp


def distance(a, b, mismatch, gap):
    return mismatch * sum(x != y for x, y in zip(a, b)) + gap * abs(len(a) - len(b))


@pytest.mark.parametrize(("limit", "mismatch", "gap"), [(0, 1.0, 1.5), (3, 1.0, 1.5), (4, 2.0, 1.0), (100, 1.0, 1.5)])
def test_pairs_within_equal_brute_force(spark, limit, mismatch, gap):
    r = random.Random(7)
    base = ["CASSLGQAYEQYF", "CASSPGTGELFF", "CAWSVG"]
    words = {"", "c", "AC", "CASS", "cassl"} | {"".join(r.choice("ACGS") for _ in range(r.randint(0, 9))) for _ in range(25)}
    for b in base:
        for _ in range(15):
            at = r.randrange(len(b))
            words.add(b[:at] + r.choice("ACG") + b[at + 1 :] + "A" * r.randint(0, 3))
    rows = [(w,) for w in sorted(words)] + [(None,), ("CASS",), ("cass",)]
    got = [tuple(v) for v in rp.pairs_within(spark.createDataFrame(rows, "s string"), "s", limit, mismatch, gap).collect()]
    own = sorted({w.upper() for w in words})
    want = [(a, b, distance(a, b, mismatch, gap)) for a in own for b in own if a < b and distance(a, b, mismatch, gap) <= limit]
    assert sorted(got) == sorted(want)


def test_pairs_within_of_nothing(spark):
    assert rp.pairs_within(spark.createDataFrame([], "s string"), "s", 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        rp.pairs_within(spark.createDataFrame([("A",)], "s string"), "s", 3, gap=0)


def test_left_range_join_with_nulls(spark):
    a = spark.createDataFrame([("c", 1, 5, None), ("c", 1, 5, None), ("c", 4, 600, "x"), ("c", 700, 710, None), (None, 1, 5, "n"), ("c", None, 9, "m"), ("d", 1, 2, "d")], "chrom string, lo long, hi long, note string")
    b = spark.createDataFrame([("c", 5, 8, 1), ("c", 550, 560, 2), (None, 1, 9, 3)], "chrom string, b_lo long, b_hi long, k int")
    got = sorted((tuple(v) for v in iv.range_join(a, b, ("lo", "hi"), ("b_lo", "b_hi"), how="left").select("chrom", "lo", "hi", "note", "k").collect()), key=repr)
    want = [("c", 1, 5, None, 1), ("c", 1, 5, None, 1), ("c", 4, 600, "x", 1), ("c", 4, 600, "x", 2), ("c", 700, 710, None, None), (None, 1, 5, "n", None), ("c", None, 9, "m", None), ("d", 1, 2, "d", None)]
    assert got == sorted(want, key=repr)


def test_k_nearest_equals_brute_force_for_any_tiling(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randint(0, 3)) for _ in range(3)]) for i in range(60)] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(20)]
    df = spark.createDataFrame([*rows, (None, [0.0, 0.0, 0.0]), (500, None)], "id long, v array<double>")
    ask = df.where("id % 5 = 0")
    want = set()
    for q, x in rows:
        if q % 5 == 0:
            near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5, p) for p, y in rows if p != q)[:4]
            want |= {(q, i + 1, p, round(d, 9)) for i, (d, p) in enumerate(near)}
    for tile in (7, 1000):
        got = [(v.query, v.rank, v.point, round(v.distance, 9)) for v in kernels.k_nearest(df, ask, "id", "v", 4, tile).collect()]
        assert len(got) == len(want) and set(got) == want
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, v array<double>")
    assert [(v.query, v.point) for v in kernels.k_nearest(few, few.where("id = 1"), "id", "v", 5).collect()] == [(1, 2)]
    assert kernels.k_nearest(few.limit(0), few, "id", "v", 2).count() == 0
