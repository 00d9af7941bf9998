"""Peaks, methylation, accessibility, contact maps, and intensity matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import genetics
from strandlake.operators.intervals import range_join
from strandlake.operators.repertoire import share
from strandlake.operators.running import neighbour


def best_peak(fragments: DataFrame, peaks: DataFrame, key: str) -> DataFrame:
    """The peak that each fragment shares most bases with; the first of the best. Closed ranges; fragments without peak go."""
    p = peaks.select("chrom", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "peak")
    hits = range_join(fragments.select(key, "chrom", "lo", "hi"), p, ("lo", "hi"), ("p_lo", "p_hi"))
    shared = F.least("hi", "p_hi") - F.greatest("lo", "p_lo") + 1
    best = F.min(F.struct((-shared).alias("s"), F.col("p_lo").alias("l"), F.col("peak").alias("peak")))
    return hits.groupBy(key).agg(best.alias("b")).select(key, F.col("b.peak").alias("peak"), (-F.col("b.s")).alias("bases"))


def peak_support(fragments: DataFrame, peaks: DataFrame, sample: str) -> DataFrame:
    """Fragments of each sample over each peak; pairs without any are not rows."""
    p = peaks.select("chrom", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "peak")
    return range_join(fragments, p, ("lo", "hi"), ("p_lo", "p_hi")).groupBy("peak", sample).agg(F.count(F.lit(1)).alias("n"))


def simple_peaks(segments: DataFrame, depth: int, gap: int = 0) -> DataFrame:
    """Stretches of at least so much depth; those at most a gap apart are one. Rows of coverage: chrom, lo, hi, depth."""
    from strandlake.operators.intervals import islands

    deep = segments.where(F.col("depth") >= depth)
    spans = islands(deep, "lo", "hi", gap + 1)
    top = range_join(spans.select("chrom", "lo", "hi"), deep.select("chrom", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), "depth"), ("lo", "hi"), ("s_lo", "s_hi"))
    return top.groupBy("chrom", "lo", "hi").agg(F.max("depth").alias("summit"), F.sum((F.col("s_hi") - F.col("s_lo") + 1) * F.col("depth")).alias("bases"))


def bin_methylation(df: DataFrame, width: int, by: list[str]) -> DataFrame:
    bin_ = (F.floor(F.col("pos") / width) * width).alias("bin")
    g = df.groupBy("chrom", bin_, *by).agg(F.sum("methylated").alias("methylated"), F.sum("total").alias("total"))
    return g.withColumn("level", F.when(F.col("total") > 0, F.col("methylated") / F.col("total")))


def tf_idf(df: DataFrame, feature: str, cell: str, n: str) -> DataFrame:
    """Share of the cell's counts times ln(1 + cells / cells with the feature)."""
    cells = F.broadcast(df.agg(F.count_distinct(cell).alias("_cells")))
    seen = df.where(F.col(n) > 0).groupBy(feature).agg(F.count_distinct(cell).alias("_df"))
    return share(df, n, [cell], "_tf").join(seen, feature).crossJoin(cells).withColumn("tfidf", F.col("_tf") * F.log1p(F.col("_cells") / F.col("_df"))).drop("_tf", "_df", "_cells")


def co_accessibility(df: DataFrame, least: float) -> DataFrame:
    """Correlated pairs of features over the samples both have: rows (feature, sample, value)."""
    p = genetics.pair_sums(df, "feature", "sample", "value").select("a", "b", "n", genetics.correlation().alias("r"))
    return p.where(F.abs("r") >= least)


def contact_matrix(df: DataFrame, width: int) -> DataFrame:
    """Symmetric counts of (i, j) bins from pairs of positions (x, y)."""
    i, j = F.floor(F.col("x") / width), F.floor(F.col("y") / width)
    one = df.groupBy(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(one.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))


def insulation(contacts: DataFrame, width: int, n_bins: int) -> DataFrame:
    """log2(1 + mean contact across each boundary) within `width` bins on either side; absent cells count as 0."""
    cross = contacts.where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") < 2 * width))
    edge = F.explode(F.sequence(F.greatest(F.col("i"), F.col("j") - width), F.least(F.col("j") - 1, F.col("i") + width - 1)))
    s = cross.where(F.greatest(F.col("i"), F.col("j") - width) <= F.least(F.col("j") - 1, F.col("i") + width - 1)).select("n", edge.alias("bin")).groupBy("bin").agg(F.sum("n").alias("t"))
    rows = F.least(F.col("bin") + 1, F.lit(width)) * F.least(F.lit(n_bins - 1) - F.col("bin"), F.lit(width))
    return s.where(rows > 0).select("bin", F.log2(1 + F.col("t") / rows).alias("score"))


def boundaries(scores: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
    """Local minima."""
    sides = neighbour(scores, by, place, [place], F.col(value), "_l", ahead=False)
    sides = neighbour(sides, by, place, [place], F.col(value), "_r", ahead=True)
    return sides.where((F.col(value) <= F.col("_l")) & (F.col(value) <= F.col("_r"))).drop("_l", "_r")


def balance(contacts: DataFrame, scratch_write, rounds: int = 10) -> DataFrame:
    """Divides by row and column means, again and again; scratch_write(df, name) writes a table and returns it."""
    now = contacts.select("i", "j", F.col("n").cast("double").alias("v"))
    for k in range(rounds):
        row = now.groupBy("i").agg(F.sum("v").alias("s"))
        mean = F.broadcast(row.agg(F.avg("s").alias("m")))
        row = row.crossJoin(mean).select(F.col("i").alias("_k"), F.sqrt(F.col("s") / F.col("m")).alias("f"))
        now = now.join(row, F.col("i") == F.col("_k")).drop("_k").withColumn("v", F.col("v") / F.col("f")).drop("f")
        now = now.join(row, F.col("j") == F.col("_k")).drop("_k").withColumn("v", F.col("v") / F.col("f")).drop("f")
        now = scratch_write(now, f"balance_{k}")
    return now


# --- intensity matrices: rows (feature, sample, value) ---------------------------------------------------------------


def normalize(df: DataFrame, how: str, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """total: share of the sample; median: over the sample's median; log: log2(x + 1); zscore: by feature; pqn: by the median quotient to the features' medians."""
    v = F.col(value)
    if how == "log":
        return df.withColumn("normalized", F.log2(v + 1))
    if how == "total":
        return share(df, value, [sample], "normalized")
    if how == "median":
        return df.join(df.groupBy(sample).agg(F.median(value).alias("_m")), sample).withColumn("normalized", v / F.col("_m")).drop("_m")
    if how == "zscore":
        s = df.groupBy(feature).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        return df.join(s, feature).withColumn("normalized", F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")
    if how == "pqn":
        ref = df.groupBy(feature).agg(F.median(value).alias("_r"))
        q = df.join(ref, feature).where("_r > 0").groupBy(sample).agg(F.median(v / F.col("_r")).alias("_q"))
        return df.join(q, sample).withColumn("normalized", v / F.col("_q")).drop("_q")
    raise ValueError(f"unknown method: {how}")


def missing(df: DataFrame, by: str, value: str, absent: float = 0.0) -> DataFrame:
    bad = F.col(value).isNull() | F.isnan(value) | (F.col(value) == absent)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_missing"), F.avg(F.when(bad, 1.0).otherwise(0.0)).alias("fraction"))


def quality_control(df: DataFrame, kind: str, qc: str = "QC", cv: float = 0.3, lost: float = 0.5) -> DataFrame:
    """Of each feature: the variation in control samples, the missing share, and whether both are small enough."""
    x = df.groupBy("feature").agg(F.avg(F.when(F.col(kind) == qc, F.col("value"))).alias("m"), F.stddev_samp(F.when(F.col(kind) == qc, F.col("value"))).alias("s"), F.avg(F.when(F.coalesce(F.col("value"), F.lit(0.0)) == 0, 1.0).otherwise(0.0)).alias("missing"))
    x = x.withColumn("cv", F.when(F.col("m") > 0, F.col("s") / F.col("m")))
    return x.select("feature", "cv", "missing", (F.coalesce(F.col("cv") <= cv, F.lit(False)) & (F.col("missing") <= lost)).alias("passed"))


def volcano(df: DataFrame, fold: str, padj: str, least: float = 1.0, most: float = 0.05) -> DataFrame:
    sure = F.col(padj) <= most
    return df.withColumn("kind", F.when(sure & (F.col(fold) >= least), "up").when(sure & (F.col(fold) <= -least), "down").otherwise("neutral"))


def center_batches(df: DataFrame, batch: str, how: str = "mean") -> DataFrame:
    f = {"mean": F.avg, "median": F.median}[how]
    own, all_ = df.groupBy("feature", batch).agg(f("value").alias("_b")), df.groupBy("feature").agg(f("value").alias("_a"))
    return df.join(own, ["feature", batch]).join(all_, "feature").withColumn("corrected", F.col("value") - F.col("_b") + F.col("_a")).drop("_a", "_b")


def peak_table(df: DataFrame, width: float, least: float = 0.0) -> DataFrame:
    """Intensity summed in bins of an axis from its smallest value on: rows (axis, value)."""
    low = F.broadcast(df.agg(F.min("axis").alias("_l")))
    b = df.crossJoin(low).withColumn("bin", F.floor((F.col("axis") - F.col("_l")) / width)).groupBy("bin").agg(F.sum("value").alias("intensity"))
    return b.where(F.col("intensity") >= least)
