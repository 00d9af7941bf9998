"""Single cells and generalised linear models by gene."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import stats


def group_means(df: DataFrame, gene: str, group: str, value: str, sizes: DataFrame) -> DataFrame:
    """Mean of each gene in each group, cells without a row as zeros; sizes has (group, cells)."""
    return df.groupBy(gene, group).agg(F.sum(value).alias("_s")).join(sizes, group).select(gene, group, (F.col("_s") / F.col("cells")).alias("mean"))


def communication(means: DataFrame, pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """sqrt(mean ligand of the sender * mean receptor of the receiver) for each pair (ligand, receptor)."""
    s = means.select(F.col("gene").alias("ligand"), F.col("grp").alias("sender"), F.col("mean").alias("_l"))
    r = means.select(F.col("gene").alias("receptor"), F.col("grp").alias("receiver"), F.col("mean").alias("_r"))
    return pairs.join(s, "ligand").join(r, "receptor").withColumn("score", F.sqrt(F.col("_l") * F.col("_r"))).where(F.col("score") > least).drop("_l", "_r")


def module_score(df: DataFrame, cell: str, gene: str, value: str, genes: list[str]) -> DataFrame:
    """Mean of a gene set less the mean of the cell's other genes, over genes with rows."""
    inside = F.col(gene).isin(*genes)
    return df.groupBy(cell).agg((F.coalesce(F.avg(F.when(inside, F.col(value))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~inside, F.col(value))), F.lit(0.0))).alias("score"))


def velocity(df: DataFrame, gene: str, spliced: str, unspliced: str) -> DataFrame:
    """unspliced less gamma times spliced, gamma by least squares through the origin for each gene."""
    g = df.groupBy(gene).agg((F.sum(F.col(spliced) * F.col(unspliced)) / F.sum(F.col(spliced) * F.col(spliced))).alias("gamma"))
    return df.join(g, gene).withColumn("velocity", F.col(unspliced) - F.col("gamma") * F.col(spliced))


def rank_sum(df: DataFrame, gene: str, value: str, first) -> DataFrame:
    """Mann-Whitney U of the first group of each gene, and z with ties' variance. Ranks come from counts of equal values, so a gene's rows need not fit a task."""
    n = df.groupBy(gene, value).agg(F.count_if(first).alias("a"), F.count(F.lit(1)).alias("t"))
    w = Window.partitionBy(gene).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("t").over(w), F.lit(0))
    n = n.withColumn("r", below + (F.col("t") + 1) / 2)
    s = n.groupBy(gene).agg(F.sum("a").alias("n1"), F.sum("t").alias("n"), F.sum(F.col("a") * F.col("r")).alias("_r"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("_ties"))
    n1, n2, t = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    s = s.where((F.col("n1") > 0) & (n2 > 0)).withColumn("u", F.col("_r") - n1 * (n1 + 1) / 2)
    var = n1 * n2 / 12.0 * ((t + 1) - F.col("_ties") / (t * (t - 1)))
    return s.select(gene, "n1", (F.col("n") - F.col("n1")).alias("n2"), "u", F.when(var > 0, (F.col("u") - n1 * n2 / 2) / F.sqrt(var)).otherwise(0.0).alias("z"))


def synergy(df: DataFrame, gene: str, a: str, b: str, value: str) -> DataFrame:
    """mean AB - mean A - mean B + mean of neither, for genes with all four."""
    m = lambda x, y, n: F.avg(F.when((F.col(a) == x) & (F.col(b) == y), F.col(value))).alias(n)
    s = df.groupBy(gene).agg(m(True, True, "ab"), m(True, False, "a_"), m(False, True, "b_"), m(False, False, "c_")).na.drop()
    return s.select(gene, (F.col("ab") - F.col("a_") - F.col("b_") + F.col("c_")).alias("synergy"))


def fit_nb(y: np.ndarray, x: np.ndarray, offset: np.ndarray, alpha: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors of a negative binomial with log link, by reweighted least squares."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(y.mean(), 1e-8)) - offset.mean()
    for _ in range(rounds):
        eta = np.clip(x @ beta + offset, -30, 30)
        mu = np.maximum(np.exp(eta), 1e-8)
        w = mu / (1 + alpha * mu)
        h = x.T @ (w[:, None] * x) + 1e-9 * np.eye(x.shape[1])
        new = np.linalg.solve(h, x.T @ (w * (eta - offset + (y - mu) / mu)))
        done, beta = np.abs(new - beta).max() < 1e-9, new
        if done:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def moment_dispersion(y: np.ndarray, size: np.ndarray, groups: np.ndarray) -> float:
    """From the variance of normalised counts within groups, less what the counting itself adds, over the groups' squared means."""
    q = y / size
    over, squares = 0.0, 0.0
    for g in np.unique(groups):
        own = groups == g
        v, m = q[own], q[own].mean()
        over += ((v - m) ** 2).sum() - (len(v) - 1) * m * (1 / size[own]).mean()
        squares += (len(v) - 1) * m * m
    return max(1e-8, over / squares) if squares > 0 else 1e-8


def negative_binomial_test(counts: DataFrame, design: DataFrame, factors: DataFrame, gene: str = "gene", sample: str = "sample", n: str = "count") -> DataFrame:
    """Wald test of a two-group design (sample, grp 0 or 1) for each gene: log2 fold change, its error, z, p and adjusted p. A group is a gene: as many rows as samples."""
    rows = counts.join(design, sample).join(factors, sample).select(gene, sample, F.col(n).cast("double").alias("y"), F.col("grp").cast("double").alias("g"), F.col("size_factor").alias("s"))
    kind = counts.schema[gene].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(sample)
        y, g, s = f.y.to_numpy(), f.g.to_numpy(), f.s.to_numpy()
        if len(np.unique(g)) < 2 or y.sum() == 0:
            return pd.DataFrame(columns=[gene, "base_mean", "dispersion", "log2fc", "se", "z"])
        alpha = moment_dispersion(y, s, g)
        beta, se = fit_nb(y, np.column_stack([np.ones(len(y)), g]), np.log(s), alpha)
        return pd.DataFrame([(f[gene].iloc[0], (y / s).mean(), alpha, beta[1] / np.log(2), se[1] / np.log(2), beta[1] / se[1])], columns=[gene, "base_mean", "dispersion", "log2fc", "se", "z"])

    fitted = rows.groupBy(gene).applyInPandas(run, f"{gene} {kind}, base_mean double, dispersion double, log2fc double, se double, z double")
    return stats.adjust_bh(fitted.withColumn("pvalue", stats.normal_p2(F.col("z"))), "pvalue", gene)


def principal_components(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Coordinates on the first k components, by the library's distributed covariance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="pc").fit(v)
    return model.transform(v).select(key, vector_to_array("pc").alias("pc"))


def clusters(df: DataFrame, key: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(v).transform(v).select(key, "cluster")
