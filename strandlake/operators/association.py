"""Association statistics over summary tables and genotype counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import stats
from strandlake.operators import genetics
from strandlake.operators.blocks import pair_totals

#: Median of a chi-square variable of one degree of freedom.
MEDIAN_CHI2 = 0.4549


def genomic_control(df: DataFrame, z: str = "z") -> DataFrame:
    """Each z over the root of lambda (at least 1), lambda the median of z squared over its expectation."""
    lam = F.broadcast(df.agg((F.median(F.col(z) * F.col(z)) / MEDIAN_CHI2).alias("lambda")))
    return df.crossJoin(lam).withColumn("z_adjusted", F.col(z) / F.sqrt(F.greatest("lambda", F.lit(1.0))))


def storey(df: DataFrame, p: str, key: str, cut: float = 0.5) -> DataFrame:
    """pi0 (the share of p over the cut, by what is expected, at most 1) and q-values."""
    pi0 = F.broadcast(df.agg(F.least(F.count_if(F.col(p) > cut) / ((1 - cut) * F.count(F.lit(1))), F.lit(1.0)).alias("pi0")))
    return stats.adjust_bh(df, p, key, "_bh").crossJoin(pi0).withColumn("q", F.col("_bh") * F.col("pi0")).drop("_bh")


def trend_test(df: DataFrame, status: DataFrame) -> DataFrame:
    """Cochran-Armitage trend of cases over dosages 0, 1, 2, for each variant; status has (sample, status)."""
    j = df.where("dosage is not null").join(status, "sample")
    s = j.groupBy("snp").agg(F.count(F.lit(1)).alias("n"), F.sum("status").alias("r"), F.sum(F.col("dosage") * F.col("status")).alias("xr"), F.sum("dosage").alias("x"), F.sum(F.col("dosage") * F.col("dosage")).alias("xx"))
    n, r, x, xx, xr = (F.col(c).cast("double") for c in ("n", "r", "x", "xx", "xr"))
    var = r * (n - r) * (n * xx - x * x) / n
    return s.select("snp", "n", F.col("r").alias("cases"), F.when(var > 0, (n * xr - r * x) ** 2 / var).alias("chi_square"))


def genotype_table(df: DataFrame, status: DataFrame) -> DataFrame:
    """Cases and controls of each dosage: a0, a1, a2 and c0, c1, c2. All that a logistic model without covariates needs."""
    j = df.where("dosage is not null").join(status, "sample")
    cells = [F.count_if((F.col("dosage") == g) & (F.col("status") == s)).alias(f"{n}{g}") for s, n in ((1, "a"), (0, "c")) for g in (0, 1, 2)]
    return j.groupBy("snp").agg(*cells)


def logistic_from_counts(a: np.ndarray, c: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and standard errors of many logistic models at once; rows are variants, columns dosages."""
    g, n = np.arange(3.0), a + c
    b0, b1 = np.log((a.sum(1) + 0.5) / (c.sum(1) + 0.5)), np.zeros(len(a))
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(b0[:, None] + b1[:, None] * g, -30, 30)))
            w, e = n * p * (1 - p), a - n * p
            s0, s1, s2 = w.sum(1), (w * g).sum(1), (w * g * g).sum(1)
            u0, u1 = e.sum(1), (e * g).sum(1)
            det = s0 * s2 - s1 * s1
            b0, b1 = b0 + np.clip((s2 * u0 - s1 * u1) / det, -5, 5), b1 + np.clip((s0 * u1 - s1 * u0) / det, -5, 5)
        return b1, np.sqrt(s0 / det)


def logistic_scan(df: DataFrame, status: DataFrame) -> DataFrame:
    """Log odds ratio a copy, its error, z and p, for each variant; the six counts of a variant are one row."""
    t = genotype_table(df, status)
    kind = t.schema["snp"].dataType.simpleString()

    def run(frames):
        for f in frames:
            a, c = (f[[f"{x}{g}" for g in range(3)]].to_numpy(float) for x in "ac")
            b, se = logistic_from_counts(a, c)
            yield pd.DataFrame({"snp": f.snp, "beta": b, "se": se})

    fitted = t.mapInPandas(run, f"snp {kind}, beta double, se double").where(F.col("se") > 0)
    return fitted.withColumn("z", F.col("beta") / F.col("se")).withColumn("pvalue", stats.normal_p2(F.col("z")))


def bayes_factor(beta: Column, se: Column, prior: float = 0.2) -> Column:
    """Log of Wakefield's approximate Bayes factor."""
    shrink = prior**2 / (se * se + prior**2)
    return 0.5 * (F.log(1 - shrink) + shrink * (beta / se) * (beta / se))


def inclusion_probability(df: DataFrame, locus: str, prior: float = 0.2) -> DataFrame:
    """Share of each variant in its locus' evidence; the largest factor is taken out before exponentials."""
    x = df.withColumn("_l", bayes_factor(F.col("beta"), F.col("se"), prior))
    top = x.groupBy(locus).agg(F.max("_l").alias("_m"))
    x = x.join(top, locus).withColumn("_e", F.exp(F.col("_l") - F.col("_m")))
    total = x.groupBy(locus).agg(F.sum("_e").alias("_t"))
    return x.join(total, locus).withColumn("pip", F.col("_e") / F.col("_t")).drop("_l", "_m", "_e", "_t")


def colocalisation(a: DataFrame, b: DataFrame, p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5, prior: float = 0.2) -> DataFrame:
    """Posterior of no signal, one in a, one in b, two, and one shared, from matched variants: one row."""
    j = a.select("snp", bayes_factor(F.col("beta"), F.col("se"), prior).alias("x")).join(b.select("snp", bayes_factor(F.col("beta"), F.col("se"), prior).alias("y")), "snp")
    top = F.broadcast(j.agg(F.max("x").alias("mx"), F.max("y").alias("my"), F.max(F.col("x") + F.col("y")).alias("mz")))
    s = j.crossJoin(top).groupBy("mx", "my", "mz").agg(F.sum(F.exp(F.col("x") - F.col("mx"))).alias("sx"), F.sum(F.exp(F.col("y") - F.col("my"))).alias("sy"), F.sum(F.exp(F.col("x") + F.col("y") - F.col("mz"))).alias("sz"))
    lx, ly, lz = F.log("sx") + F.col("mx"), F.log("sy") + F.col("my"), F.log("sz") + F.col("mz")
    apart = lx + ly + F.log(F.greatest(1 - F.exp(lz - lx - ly), F.lit(1e-300)))
    h = [F.lit(0.0), lx + math.log(p1), ly + math.log(p2), apart + math.log(p1 * p2), lz + math.log(p12)]
    s = s.select(*[x.alias(f"h{i}") for i, x in enumerate(h)])
    best = F.greatest(*[F.col(f"h{i}") for i in range(5)])
    e = [F.exp(F.col(f"h{i}") - best) for i in range(5)]
    return s.select(*[(x / sum(e[1:], e[0])).alias(f"pp{i}") for i, x in enumerate(e)])


def mendelian_randomisation(df: DataFrame) -> DataFrame:
    """Inverse-variance and Egger estimates and Cochran's Q from rows (bx, by, se): one row. Egger flips variants to bx >= 0."""
    w = 1 / (F.col("se") * F.col("se"))
    x, y = F.abs("bx"), F.when(F.col("bx") < 0, -F.col("by")).otherwise(F.col("by"))
    s = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in (("w", w), ("wx", w * x), ("wy", w * y), ("wxx", w * x * x), ("wxy", w * x * y), ("wyy", w * y * y))])
    c = F.col
    ivw = c("wxy") / c("wxx")
    det = c("w") * c("wxx") - c("wx") * c("wx")
    slope = (c("w") * c("wxy") - c("wx") * c("wy")) / det
    return s.select("n", ivw.alias("ivw"), F.sqrt(1 / c("wxx")).alias("ivw_se"), (c("wyy") - ivw * c("wxy")).alias("q"), slope.alias("egger"), ((c("wy") - slope * c("wx")) / c("w")).alias("intercept"))


def ld_scores(df: DataFrame, window: int) -> DataFrame:
    """1 + the sum of r2 with all variants at most `window` apart; NaN if one of these has no r2, as it doesn't vary over the samples both have."""
    r2 = genetics.linkage(df, window)
    both = r2.select(F.explode(F.array("a", "b")).alias("snp"), "r2").groupBy("snp").agg(F.sum("r2").alias("_s"))
    return df.select("snp").distinct().join(both, "snp", "left").select("snp", (1 + F.coalesce("_s", F.lit(0.0))).alias("ld_score"))


def relationship(df: DataFrame) -> DataFrame:
    """VanRaden's relationship of pairs of samples a <= b: sum of centred dosages' products over 2 sum p(1-p), missing ones as the mean."""
    p = df.where("dosage is not null").groupBy("snp").agg((F.avg("dosage") / 2).alias("p"))
    scale = F.broadcast(p.agg((2 * F.sum(F.col("p") * (1 - F.col("p")))).alias("_k")))
    z = df.where("dosage is not null").join(p, "snp").select("snp", "sample", (F.col("dosage") - 2 * F.col("p")).alias("z"))
    return pair_totals(z, "sample", "snp", "z", lambda x, y: x * y, itself=True).crossJoin(scale).select("a", "b", (F.col("s") / F.col("_k")).alias("relationship"))


def burden(df: DataFrame, sets: DataFrame, phenotype: DataFrame) -> DataFrame:
    """Linear scan of the summed dosage of each set; sets has (snp, term)."""
    s = df.join(sets, "snp").groupBy("term", "sample").agg(F.sum("dosage").alias("dosage"))
    return genetics.linear_scan(s.withColumnRenamed("term", "snp"), phenotype).withColumnRenamed("snp", "term")


def inverse_normal(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Normal quantile of (rank - 3/8) / (n + 1/4), ties at their mean rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn("_u", (stats.average_rank(value, by) - 0.375) / (n + 0.25)).withColumn("normal", stats._udf(stats.norm_ppf)(F.col("_u"))).drop("_u")


def heterozygosity_outliers(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    h = df.where("dosage is not null").groupBy("sample").agg(F.avg(F.when(F.col("dosage") == 1, 1.0).otherwise(0.0)).alias("het"))
    s = F.broadcast(h.agg(F.avg("het").alias("_m"), F.stddev_samp("het").alias("_s")))
    h = h.crossJoin(s).withColumn("z", F.when(F.col("_s") > 0, (F.col("het") - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")
    return h.withColumn("outlier", F.abs("z") > threshold)


def score_regression(df: DataFrame, n: float) -> DataFrame:
    """Heritability from the slope of chi-square on LD scores: rows (chi_square, ld_score); one row."""
    s = df.agg(F.count(F.lit(1)).alias("m"), F.regr_slope("chi_square", "ld_score").alias("slope"), F.regr_intercept("chi_square", "ld_score").alias("intercept"))
    return s.withColumn("h2", F.col("slope") * F.col("m") / n)


def liftover(df: DataFrame, positions: DataFrame) -> DataFrame:
    """New positions by (chrom, pos); what has none keeps the old one and is flagged."""
    m = positions.select("chrom", "pos", "new_pos")
    return df.join(m, ["chrom", "pos"], "left").select(*[c for c in df.columns if c != "pos"], F.coalesce("new_pos", "pos").alias("pos"), F.col("new_pos").isNotNull().alias("mapped"))


def permutation_p(observed: Column, null: DataFrame, value: str) -> DataFrame:
    return null.agg(((1 + F.count_if(F.abs(value) >= F.abs(observed))) / (F.count(F.lit(1)) + 1)).alias("pvalue"))
