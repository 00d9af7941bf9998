"""Distribution tails in numpy, as Arrow-batched UDFs, and rank-based corrections as windows.

No special-function library is needed: the incomplete gamma and beta functions are summed from their series and
continued fractions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandlake.operators.running import running

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x):
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def norm_sf(z):
    return 0.5 * np.asarray(_erfc(np.asarray(z, float) / math.sqrt(2)), float)


def norm_ppf(p):
    """Quantile of the normal distribution, by Newton steps from a rational start."""
    p = np.asarray(p, float)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    z = np.sign(p - 0.5) * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
    for _ in range(4):
        z = z - (1 - norm_sf(z) - p) / np.maximum(np.exp(-z * z / 2) / math.sqrt(2 * math.pi), 1e-300)
    return z


def gamma_sf(a, x):
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(x.shape)
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(x) - lgamma(a))
        low = (x > 0) & (x < a + 1)
        term, total, n = 1 / a, 1 / a, a.copy()
        for _ in range(500):
            n = n + 1
            term = term * x / n
            total = total + term
        out = np.where(low, 1 - front * total, out)
        b, c = x + 1 - a, np.full(x.shape, 1e300)
        d = 1 / b
        h = d.copy()
        for i in range(1, 500):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            h = h * d * c
        return np.where((x > 0) & ~low, front * h, out)


def chi2_sf(x, df):
    return gamma_sf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def beta_cdf(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c = np.ones(y.shape)
        d = 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
                c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
                h = h * d * c
        value = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def t_sf2(t, df):
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def hypergeom_sf(k, total, good, draws):
    """P(X >= k) for X good ones among the draws."""
    out = []
    for kk, n, g, m in zip(*(np.atleast_1d(v).astype(int) for v in (k, total, good, draws)), strict=True):
        x = np.arange(max(kk, 0, m + g - n), min(g, m) + 1)
        if not len(x):
            out.append(0.0)
            continue
        logs = lgamma(g + 1) - lgamma(x + 1) - lgamma(g - x + 1) + lgamma(n - g + 1) - lgamma(m - x + 1) - lgamma(n - g - m + x + 1) - (lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1))
        out.append(min(1.0, float(np.exp(logs).sum())))
    return np.array(out)


def binom_test(k, n, p=0.5):
    """Two-sided, twice the smaller tail."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    upper = np.where(k <= 0, 1.0, beta_cdf(np.maximum(k, 1e-9), n - k + 1, p))
    lower = np.where(k >= n, 1.0, 1 - beta_cdf(k + 1, np.maximum(n - k, 1e-9), p))
    return np.minimum(1.0, 2 * np.minimum(upper, lower))


def hwe_exact(hom_a: int, het: int, hom_b: int) -> float:
    """Exact Hardy-Weinberg p-value: the probability of all heterozygote counts no likelier than the one seen."""
    n, rare = hom_a + het + hom_b, 2 * min(hom_a, hom_b) + het
    if n == 0:
        return 1.0
    h = np.arange(rare % 2, rare + 1, 2)
    a, b = (rare - h) // 2, n - h - (rare - h) // 2
    logs = lgamma(n + 1) - lgamma(a + 1) - lgamma(h + 1) - lgamma(b + 1) + h * math.log(2)
    w = np.exp(logs - logs.max())
    w /= w.sum()
    return float(min(1.0, w[w <= w[h == het][0] * (1 + 1e-9)].sum()))


def _udf(f):
    return F.pandas_udf(lambda *x: pd.Series(np.asarray(f(*(v.to_numpy(float) for v in x)), float)), DoubleType())


def chi2_p(x: Column, df: Column) -> Column:
    return _udf(chi2_sf)(x, df)


def normal_p2(z: Column) -> Column:
    return _udf(lambda v: 2 * norm_sf(np.abs(v)))(z)


def t_p2(t: Column, df: Column) -> Column:
    return _udf(t_sf2)(t, df)


def hypergeom_p(k: Column, total: Column, good: Column, draws: Column) -> Column:
    return _udf(hypergeom_sf)(k, total, good, draws)


def binom_p(k: Column, n: Column) -> Column:
    return _udf(binom_test)(k, n)


def hwe_p(a: Column, h: Column, b: Column) -> Column:
    return _udf(lambda x, y, z: [hwe_exact(int(i), int(j), int(k)) for i, j, k in zip(x, y, z, strict=True)])(a, h, b)


def adjust_bh(df: DataFrame, p: str, key: str, name: str = "padj") -> DataFrame:
    """Benjamini-Hochberg values. Ranks and the running minimum from above are found bin by bin of p, not in one task."""
    m = F.broadcast(df.agg(F.count(p).alias("_m")))
    ranked = running(df, [], p, [p, key], F.lit(1), "sum", "_rank", bin_width=1 / 1024)
    ranked = ranked.crossJoin(m).withColumn("_neg", -F.col(p)).withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    out = running(ranked, [], "_neg", ["_neg", F.desc("_rank")], F.col("_q"), "min", name, bin_width=1 / 1024)
    return out.withColumn(name, F.least(F.col(name), F.lit(1.0))).drop("_m", "_rank", "_neg", "_q")


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks with ties at their mean."""
    ties = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2
