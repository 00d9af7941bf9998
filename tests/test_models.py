"""Models by gene, torsions, features and digests against known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import cells, features, structure


def test_negative_binomial_recovers_fold_change():
    r = np.random.default_rng(1)
    g = np.repeat([0.0, 1.0], 200)
    s = r.uniform(0.5, 2, 400)
    mu = 50 * s * 4**g
    y = r.negative_binomial(5, 5 / (5 + mu)).astype(float)
    alpha = cells.moment_dispersion(y, s, g)
    beta, se = cells.fit_nb(y, np.column_stack([np.ones(400), g]), np.log(s), alpha)
    assert alpha == pytest.approx(0.2, rel=0.3)
    assert beta[1] == pytest.approx(np.log(4), abs=4 * se[1]) and beta[0] == pytest.approx(np.log(50), abs=4 * se[0])


def test_torsion(spark):
    points = [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1)]
    cols = [F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(p, "xyz")]) for p in points]
    assert abs(spark.range(1).select(structure.torsion(cols)).first()[0]) == pytest.approx(90.0)


def test_features_and_digest(spark):
    df = spark.createDataFrame([(1, "AAACCCGGGTTT", "complement(join(1..3,7..>9))"), (2, "ACGT", "2")], "k long, seq string, loc string")
    got = {r.k: (r.part, r.b.start, r.b.stop) for r in df.select("k", features.extract(F.col("seq"), F.col("loc")).alias("part"), features.bounds(F.col("loc")).alias("b")).collect()}
    assert got == {1: ("CCCTTT", 1, 9), 2: ("C", 2, 2)}
    cut = spark.createDataFrame([(1, "AAGAATTCAAGAATTCC"), (2, "GGG")], "k long, seq string")
    assert sorted(tuple(r) for r in features.fragments(cut, "k", "seq", "EcoRI").collect()) == [(1, 0, 0, 3), (1, 1, 3, 8), (1, 2, 11, 6), (2, 0, 0, 3)]
