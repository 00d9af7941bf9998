import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.operators import cohort, residues


def test_cox_is_the_maximum_of_the_partial_likelihood(spark):
    r = random.Random(3)
    rows = [(r.randint(1, 40), int(r.random() < 0.7), r.gauss(0, 1), float(r.random() < 0.5)) for _ in range(300)]
    rows = [(max(1, int(t * math.exp(-0.6 * x + 0.4 * y))), d, x, y) for t, d, x, y in rows]
    found = cohort.cox(spark.createDataFrame([*rows, (3, 1, None, 0.0)], "t int, d int, x double, y double"), "t", "d", ["x", "y"])
    data = np.array(rows, float)

    def loglik(b):
        risk = data[:, 2:] @ b
        return sum(risk[i] - math.log(np.exp(risk[data[:, 0] >= data[i, 0]]).sum()) for i in range(len(data)) if data[i, 1])

    beta = np.array([f["beta"] for f in found])
    steps = [np.array([e, 0]) for e in (1e-4, -1e-4)] + [np.array([0, e]) for e in (1e-4, -1e-4)]
    assert all(loglik(beta) >= loglik(beta + s) for s in steps) and found[0]["beta"] > 0.3
    h = 1e-3
    second = (loglik(beta + [h, 0]) - 2 * loglik(beta) + loglik(beta - [h, 0])) / h**2
    cross = (loglik(beta + [h, h]) - loglik(beta + [h, -h]) - loglik(beta + [-h, h]) + loglik(beta - [h, h])) / (4 * h**2)
    other = (loglik(beta + [0, h]) - 2 * loglik(beta) + loglik(beta - [0, h])) / h**2
    se = np.sqrt(np.diag(np.linalg.inv(-np.array([[second, cross], [cross, other]]))))
    assert found[0]["se"] == pytest.approx(se[0], rel=1e-3) and found[1]["se"] == pytest.approx(se[1], rel=1e-3)


def test_isoelectric_point_and_instability(spark):
    proteins = ["ACDEFGHIKLMNPQRSTVWY", "KKKKRR", "DDDEEE", "", "GGG", "mkvhc"]
    pk_up, pk_down = dict(sq.PK_POSITIVE), dict(sq.PK_NEGATIVE)

    def net(p, ph):
        up = 1 / (1 + 10 ** (ph - sq.PK_FIRST)) + sum(p.upper().count(a) / (1 + 10 ** (ph - k)) for a, k in pk_up.items())
        return up - 1 / (1 + 10 ** (sq.PK_LAST - ph)) - sum(p.upper().count(a) / (1 + 10 ** (k - ph)) for a, k in pk_down.items())

    df = spark.createDataFrame(list(enumerate(proteins)), "k int, p string")
    for r in df.select("k", sq.isoelectric_point(F.col("p")).alias("pi")).collect():
        p = proteins[r["k"]]
        assert net(p, r["pi"] - 1e-3) > 0 > net(p, r["pi"] + 1e-3)
    weights = spark.createDataFrame([("GG", 2.0), ("AC", -1.0), ("KR", 5.0)], "pair string, weight double")
    got = dict(sq.instability_index(df, weights, "k", "p").collect())
    assert got == {0: pytest.approx(-0.5), 1: pytest.approx(10 / 6 * 5), 2: 0.0, 4: pytest.approx(10 / 3 * 4), 5: 0.0}


def test_primers(spark):
    df = spark.createDataFrame([("AAAACGTT", "CCAACGTTGG"), ("AAAA", "CCCC"), ("A", "T")], "a string, b string")
    assert [r[0] for r in df.select(sq.primer_dimer(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_selection_errors(spark):
    with pytest.raises(ValueError):
        residues.selection("chain")
    with pytest.raises(ValueError):
        residues.selection("(name CA")
    with pytest.raises(ValueError):
        residues.selection("name CA chain A")


def test_hydrogen_bond_and_pdb(spark, tmp_path):
    rows = [
        (1, "A", 1, "C", "ALA", -2.3, 0.0, 0.0), (1, "A", 1, "N", "ALA", -1.0, 0.0, 0.0), (1, "A", 1, "O", "ALA", -3.0, 1.0, 0.0),
        (1, "A", 9, "O", "GLY", 2.0, 0.0, 0.0), (1, "A", 9, "C", "GLY", 3.2, 0.0, 0.0), (1, "A", 9, "N", "GLY", 4.5, 0.0, 0.0),
    ]
    atoms = spark.createDataFrame([(*x, 10.0, k + 1) for k, x in enumerate(rows)], "structure int, chain string, resseq long, atom string, residue string, x double, y double, z double, bfactor double, id long")
    (bond,) = residues.hydrogen_bonds(atoms).collect()
    assert (bond["donor_resseq"], bond["acceptor_resseq"], bond["distance"], round(bond["angle"])) == (1, 9, 3.0, 180)
    residues.write_pdb(atoms, f"{tmp_path}/pdb")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/pdb/structure=1").collect()]
    assert len(lines) == 6 and lines[1] == "ATOM      2  N   ALA A   1      -1.000   0.000   0.000  1.00 10.00           N"
    assert (lines[1][30:38], lines[1][22:26], lines[1][17:20]) == ("  -1.000", "   1", "ALA")


def test_related(spark):
    r = random.Random(1)
    own = {s: [r.randint(0, 2) for _ in range(60)] for s in range(5)}
    own[5] = own[0]
    df = spark.createDataFrame([(s, k, g if (s + k) % 13 else None) for s, x in own.items() for k, g in enumerate(x)], "sample int, snp int, dosage int")
    assert {(x["a"], x["b"]) for x in cohort.related_pairs(cohort.kinship(df), 0.3).collect()} == {(0, 5)}
