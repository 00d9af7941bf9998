"""Cohorts: proportional hazards, kinship, reports of samples, and checks of association results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.running import running


def cox(df: DataFrame, time: str, status: str, covariates: list[str], rounds: int = 25, tolerance: float = 1e-9) -> list[dict]:
    """Proportional hazards by Newton's steps; of equal times all are at risk at each event (Breslow).

    A step is one pass: rows are summed up by time, the sums of all later times are carried in bin by bin, and one row of
    sums comes to the driver. Returns a dict (term, beta, se, z) for each covariate; rows with a null take no part.
    """
    k = len(covariates)
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(status).cast("double").alias("d"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    beta = np.zeros(k)
    hessian = np.eye(k)
    for _ in range(rounds):
        risk = F.exp(sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)))
        sums = {"r": risk} | {f"r{i}": risk * F.col(f"x{i}") for i in range(k)} | {f"r{i}_{j}": risk * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}
        by_time = rows.groupBy("t").agg(F.sum("d").alias("events"), *[F.sum(F.col("d") * F.col(f"x{i}")).alias(f"d{i}") for i in range(k)], *[F.sum(v).alias(n) for n, v in sums.items()])
        at_risk = by_time.withColumn("late", -F.col("t"))
        for n in sums:
            at_risk = running(at_risk, [], "late", ["late"], F.col(n), "sum", f"s_{n}", bin_width=256.0)
        mean = [F.col(f"s_r{i}") / F.col("s_r") for i in range(k)]
        spread = [F.col("events") * (F.col(f"s_r{i}_{j}") / F.col("s_r") - mean[i] * mean[j]) for i, j in pairs]
        got = at_risk.where("events > 0").agg(*[F.sum(F.col(f"d{i}") - F.col("events") * mean[i]).alias(f"g{i}") for i in range(k)], *[F.sum(s).alias(f"h{i}_{j}") for (i, j), s in zip(pairs, spread)]).first()
        if got["g0"] is None:
            break
        gradient = np.array([got[f"g{i}"] for i in range(k)])
        hessian = np.array([[got[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) + 1e-12 * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() <= tolerance * (1 + np.abs(beta).max()):
            break
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(hessian)), 0))
    return [{"term": c, "beta": float(b), "se": float(s), "z": float(b / s) if s else float("nan")} for c, b, s in zip(covariates, beta, se, strict=True)]


def kinship(genotypes: DataFrame, sample: str = "sample", snp: str = "snp", dosage: str = "dosage") -> DataFrame:
    """(a, b, kinship) of samples a <= b with a SNP in common: products of centred dosages over twice the summed variances."""
    known = genotypes.where(F.col(dosage).isNotNull()).select(F.col(sample).alias("s"), F.col(snp).alias("m"), F.col(dosage).cast("double").alias("g"))
    freq = known.groupBy("m").agg((F.avg("g") / 2).alias("p")).withColumn("v", 2 * F.col("p") * (1 - F.col("p"))).where("v > 1e-15")
    rows = known.join(freq, "m").select("s", "m", "v", (F.col("g") - 2 * F.col("p")).alias("c"))
    pairs = rows.select(F.col("s").alias("a"), "m", "v", F.col("c").alias("x")).join(rows.select(F.col("s").alias("b"), "m", F.col("c").alias("y")), "m").where("a <= b")
    return pairs.groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / (2 * F.sum("v"))).alias("kinship"))


def related_pairs(kin: DataFrame, threshold: float = 0.0884) -> DataFrame:
    return kin.where((F.col("a") < F.col("b")) & (F.col("kinship") >= threshold))


def sample_report(genotypes: DataFrame, missing_threshold: float = 0.05, het_threshold: float = 3.0, sample: str = "sample", dosage: str = "dosage") -> DataFrame:
    """Call rate, heterozygosity and its distance from the mean in standard deviations, and whether a sample passes both."""
    g = F.col(dosage)
    one = genotypes.groupBy(sample).agg((F.count(g) / F.count(F.lit(1))).alias("call_rate"), F.when(F.count(g) > 0, F.count_if(g == 1) / F.count(g)).alias("het"))
    all_ = F.broadcast(one.agg(F.avg("het").alias("_m"), F.stddev_samp("het").alias("_s")))  # one row
    z = F.when(F.col("_s") > 0, (F.col("het") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return one.crossJoin(all_).select(sample, "call_rate", "het", z.alias("het_z")).withColumn("passes", (1 - F.col("call_rate") <= missing_threshold) & F.coalesce(F.abs("het_z") <= het_threshold, F.lit(False)))


def sex_check(genotypes: DataFrame, chrom: str = "chrom", sample: str = "sample", dosage: str = "dosage", female: float = 0.2, male: float = 0.05) -> DataFrame:
    """Heterozygosity on X and Y, and the sex that X suggests."""
    on = lambda *names: F.lower(F.col(chrom)).isin(*names)
    share = lambda here: F.count_if(here & (F.col(dosage) == 1)) / F.nullif(F.count_if(here & F.col(dosage).isNotNull()), F.lit(0))
    x, y = on("x", "chrx", "23"), on("y", "chry", "24")
    rows = genotypes.groupBy(sample).agg(share(x).alias("x_het"), share(y).alias("y_het"))
    return rows.withColumn("inferred", F.when(F.col("x_het") >= female, "F").when(F.col("x_het") <= male, "M").otherwise("unknown"))


def normalise_chromosome(name: Column) -> Column:
    """Without chr, upper case, 23 to 26 as X, Y, XY, MT."""
    bare = F.upper(F.regexp_replace(F.trim(name), "(?i)^chr", ""))
    return F.when(bare == "23", "X").when(bare == "24", "Y").when(bare == "25", "XY").when(bare.isin("26", "M"), "MT").otherwise(bare)


def qq(pvalues: DataFrame, p: str = "p") -> DataFrame:
    """(p, observed, expected): each p value's rank among all gives what would be expected. Ranks are counted bin by bin of -log10 p."""
    rows = pvalues.select(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(2.220446049250313e-16)).alias("p"))
    counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("m")).withColumn("late", F.log10("p"))
    ranked = running(counts, [], "late", ["late"], F.col("m"), "sum", "upto", bin_width=0.01)
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))  # one row
    each = ranked.crossJoin(total).withColumn("rank", F.explode(F.sequence(F.col("upto") - F.col("m") + 1, F.col("upto"))))
    return each.select("p", (-F.log10("p")).alias("observed"), (-F.log10((F.col("rank") - 0.5) / F.col("n"))).alias("expected"))


def effective_n(results: DataFrame, beta: str = "beta", se: str = "se") -> DataFrame:
    return results.where(F.col(se) > 0).agg(F.median((F.col(beta) / F.col(se)) ** 2).alias("n"))


def pleiotropy(effects: DataFrame, beta_exp: str = "beta_exp", se_exp: str = "se_exp", beta_out: str = "beta_out", se_out: str = "se_out") -> DataFrame:
    """(q, df): heterogeneity of the ratio estimates about their inverse-variance mean; one row."""
    be, bo, so, s = F.col(beta_exp), F.col(beta_out), F.col(se_out), F.col(se_exp)
    rows = effects.where((be != 0) & (so > 0) & (s > 0)).select(be.alias("x"), bo.alias("y"), s.alias("sx"), so.alias("sy"))
    mean = F.broadcast(rows.agg((F.sum(F.col("x") * F.col("y") / F.col("sy") ** 2) / F.sum(F.col("x") ** 2 / F.col("sy") ** 2)).alias("b")))  # one row
    ratio, var = F.col("y") / F.col("x"), F.col("sy") ** 2 / F.col("x") ** 2 + F.col("y") ** 2 * F.col("sx") ** 2 / F.col("x") ** 4
    return rows.crossJoin(mean).agg(F.sum((ratio - F.col("b")) ** 2 / var).alias("q"), (F.count(F.lit(1)) - 1).alias("df"))


def egger(effects: DataFrame, beta_exp: str = "beta_exp", beta_out: str = "beta_out", se_out: str = "se_out") -> DataFrame:
    """(intercept, slope): weighted regression of outcome on exposure effects, all exposure effects made positive; one row of sums."""
    sign = F.signum(beta_exp)
    rows = effects.select((F.col(beta_exp) * sign).alias("x"), (F.col(beta_out) * sign).alias("y"), (1 / F.col(se_out) ** 2).alias("w"))
    s = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.col("x") ** 2).alias("xx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"))
    slope = (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("w") * F.col("xx") - F.col("x") ** 2)
    return s.select(((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"), slope.alias("slope"))
