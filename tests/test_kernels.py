"""Distribution tails and interval algebra against known values and brute force."""

import random

import numpy as np
import pytest

from strandlake.functions import stats
from strandlake.operators import intervals as iv


def test_tails():
    close = lambda a, b: np.testing.assert_allclose(a, b, rtol=1e-4)
    close(stats.t_sf2([2.0, 1.0, 0.0], [10, 5, 3]), [0.0733880, 0.3632175, 1.0])
    close(stats.chi2_sf([3.841459, 10.0, 0.0], [1, 5, 2]), [0.05, 0.0752352, 1.0])
    close(stats.f_sf([4.0], [2], [10]), [0.0529221])
    close(stats.norm_ppf([0.975, 0.5, 0.001]) + 1, [2.959964, 1.0, -2.090232])
    close(stats.hypergeom_sf([3], [20], [7], [5]), [0.2067853])
    close(stats.binom_test([8, 5, 0], [10, 10, 10]), [0.109375, 1.0, 0.00195312])
    assert stats.hwe_exact(25, 50, 25) == pytest.approx(1.0) and stats.hwe_exact(50, 0, 50) < 1e-20


def test_known_intervals(spark):
    df = spark.createDataFrame([("c", 10, 15), ("c", 1, 5), ("c", 5, 8)], "chrom string, start long, stop long")
    assert sorted((r.start, r.stop) for r in iv.merge_intervals(df).collect()) == [(1, 8), (10, 15)]
    bed = spark.createDataFrame([("chr1", 0, 10), ("chr1", 10, 20), ("chr2", 20, 30)], "chrom string, start long, stop long")
    assert sorted((r.window, r.covered) for r in iv.window_coverage(bed, 10, "chr1").collect()) == [(0, 10), (1, 10)]
    frag = spark.createDataFrame([("chr1", 1, 5), ("chr1", 4, 8), ("chr2", 2, 4)], "chrom string, lo long, hi long")
    assert sorted(tuple(r) for r in iv.coverage(frag).collect()) == [("chr1", 1, 3, 1), ("chr1", 4, 5, 2), ("chr1", 6, 8, 1), ("chr2", 2, 4, 1)]


def test_range_joins_equal_brute_force(spark):
    r = random.Random(20260324)
    make = lambda n: sorted({(r.choice(["chr1", "chr2", "chrX"]), lo := r.randint(1, 500), lo + r.randint(0, 40), r.choice("+-.")) for _ in range(n)})
    a, b = make(60), make(40)
    schema = "chrom string, lo long, hi long, strand string"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    hits = {(p, q) for p in a for q in b if p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2]}
    assert sorted(tuple(v) for v in iv.find_overlaps(x, y).collect()) == sorted((*p, *q[1:]) for p, q in hits)
    for how, pick in (("precede", lambda p: max(((q[2], q[1], q[3]) for q in b if q[0] == p[0] and q[2] < p[1]), default=None)), ("follow", lambda p: max(((-q[1], -q[2], q[3]) for q in b if q[0] == p[0] and q[1] > p[2]), default=None))):
        got = {tuple(v)[:4]: tuple(v)[4:] for v in getattr(iv, how)(x, y).collect()}
        for p in a:
            w = pick(p)
            want = (None, None, None) if w is None else (w[1], w[0], w[2]) if how == "precede" else (-w[0], -w[1], w[2])
            assert got[p] == want
    bases = lambda rows: {(c, k) for c, lo, hi, *_ in rows for k in range(lo, hi + 1)}
    left = bases(a) - bases(b)
    assert bases(tuple(v) for v in iv.setdiff(x, y).collect()) == left
    assert bases(tuple(v)[:3] for v in iv.reduce(x).collect()) == bases(a)
    assert bases(tuple(v) for v in iv.disjoin(x).collect()) == bases(a)


def test_empty(spark):
    none = spark.createDataFrame([], "chrom string, lo long, hi long, strand string")
    one = spark.createDataFrame([("c", 1, 5, "+")], "chrom string, lo long, hi long, strand string")
    assert iv.intersect(none, one).count() == 0 and iv.coverage(none).count() == 0 and iv.reduce(none).count() == 0
    assert [tuple(r) for r in iv.setdiff(one, none).collect()] == [("c", 1, 5, "+")]
