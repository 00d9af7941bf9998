"""Logistic models from counts against a fit row by row."""

import os

import numpy as np
import pytest

from strandlake.functions import stats
from strandlake.operators import association as asn
from strandlake.plans.views import view


def test_logistic_from_counts():
    a, c = np.array([[30.0, 25, 12], [10, 10, 10]]), np.array([[40.0, 20, 4], [12, 9, 9]])
    beta, se = asn.logistic_from_counts(a, c)
    for k in range(2):
        x = np.repeat([0, 1, 2, 0, 1, 2], np.concatenate([a[k], c[k]]).astype(int))
        y = np.repeat([1, 0], [int(a[k].sum()), int(c[k].sum())])
        b = np.zeros(2)
        m = np.column_stack([np.ones(len(x)), x])
        for _ in range(50):
            p = 1 / (1 + np.exp(-m @ b))
            h = m.T @ ((p * (1 - p))[:, None] * m)
            b = b + np.linalg.solve(h, m.T @ (y - p))
        assert beta[k] == pytest.approx(b[1], abs=1e-6) and se[k] == pytest.approx(np.sqrt(np.linalg.inv(h)[1, 1]), rel=1e-4)


def test_inverse_normal(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (5, 1, 3, 3)], "g long, v double")
    got = sorted((r.v, r.normal) for r in asn.inverse_normal(df, "v", ["g"]).collect())
    want = stats.norm_ppf((np.array([1, 2.5, 2.5, 4]) - 0.375) / 4.25)
    assert [g[1] for g in got] == pytest.approx(list(want))


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_genotypes_take_all_rows_in(spark):
    lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders"))
    pairs = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "l_suppkey").distinct()
    found = view(spark, SF, "genotypes")
    assert found.count() == pairs.count() == found.select("sample", "snp").distinct().count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan
