"""Count matrices as long tables: normalisation, differential tests, diversity, distances and batch correction.

A table has one row for each (feature, sample) with a count; zeros may be absent. Statistics that need zeros get them
from the numbers of features and samples, not from rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import stats
from strandlake.operators.repertoire import share

LN2 = 0.6931471805599453


def filter_low_counts(df: DataFrame, feature: str, n: str, min_total: float = 10, min_count: float = 1, min_samples: int = 1) -> DataFrame:
    good = df.groupBy(feature).agg(F.sum(n).alias("_t"), F.count_if(F.col(n) >= min_count).alias("_k")).where((F.col("_t") >= min_total) & (F.col("_k") >= min_samples))
    return df.join(good.select(feature), feature, "left_semi")


def size_factors(df: DataFrame, feature: str, sample: str, n: str) -> DataFrame:
    """Median of ratios to the geometric mean, over features that no sample lacks."""
    pos = df.where(F.col(n) > 0)
    samples = F.broadcast(df.agg(F.count_distinct(sample).alias("_m")))
    geo = pos.groupBy(feature).agg(F.avg(F.log(n)).alias("_g"), F.count(F.lit(1)).alias("_k")).crossJoin(samples).where("_k = _m").select(feature, "_g")
    return pos.join(geo, feature).groupBy(sample).agg(F.exp(F.median(F.log(n) - F.col("_g"))).alias("size_factor"))


def normalize(df: DataFrame, factors: DataFrame, sample: str, n: str) -> DataFrame:
    return df.join(factors, sample).withColumn("normalized", F.col(n) / F.col("size_factor"))


def counts_per_million(df: DataFrame, sample: str, n: str) -> DataFrame:
    """cpm, and log2 of (n + 0.5) / (total + 1) * 1e6."""
    total = df.groupBy(sample).agg(F.sum(n).alias("_t"))
    return df.join(total, sample).withColumns({"cpm": F.col(n) * 1e6 / F.col("_t"), "log_cpm": F.log2((F.col(n) + 0.5) / (F.col("_t") + 1.0) * 1e6)}).drop("_t")


def vst(x: Column, dispersion: Column) -> Column:
    """Variance-stabilised value of a normalised count under a negative binomial."""
    small = 2 * F.sqrt(x) / LN2
    return F.when(dispersion < 1e-10, small).otherwise(2 / F.sqrt(dispersion) * F.asinh(F.sqrt(dispersion * x)) / LN2)


def log_fold(df: DataFrame, feature: str, group: str, value: str, a: str, b: str) -> DataFrame:
    """Means, variances, log2 fold change with a pseudocount of 1, and Welch's t of group b against a."""
    of = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = df.groupBy(feature).agg(of(a, F.count).alias("na"), of(b, F.count).alias("nb"), of(a, F.avg).alias("ma"), of(b, F.avg).alias("mb"), of(a, F.var_samp).alias("va"), of(b, F.var_samp).alias("vb"))
    s = s.where((F.col("na") > 1) & (F.col("nb") > 1))
    se = F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))
    s = s.withColumns({"log2fc": F.log2((F.col("mb") + 1) / (F.col("ma") + 1)), "t": F.when(se > 0, (F.col("mb") - F.col("ma")) / se)})
    x, y = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return s.withColumn("df", F.when(x + y > 0, (x + y) ** 2 / (x * x / (F.col("na") - 1) + y * y / (F.col("nb") - 1))))


def differential(df: DataFrame, feature: str, group: str, value: str, a: str, b: str) -> DataFrame:
    """log_fold with two-sided p-values and their adjustment."""
    s = log_fold(df, feature, group, value, a, b).where("t is not null")
    return stats.adjust_bh(s.withColumn("pvalue", stats.t_p2(F.col("t"), F.col("df"))), "pvalue", feature)


def batch_residual(df: DataFrame, feature: str, batch: str, value: str) -> DataFrame:
    """value less its feature's mean in the batch, plus its mean in all batches."""
    own = df.groupBy(feature, batch).agg(F.avg(value).alias("_b"))
    all_ = df.groupBy(feature).agg(F.avg(value).alias("_a"))
    return df.join(own, [feature, batch]).join(all_, feature).withColumn("corrected", F.col(value) - F.col("_b") + F.col("_a")).drop("_a", "_b")


def tmm_pairs(df: DataFrame, feature: str, sample: str, n: str, reference: str) -> DataFrame:
    """M and A values of each feature of each sample against the reference sample."""
    p = share(df.where(F.col(n) > 0), n, [sample], "_p")
    ref = p.where(F.col(sample) == reference).select(feature, F.col("_p").alias("_r"))
    return p.join(ref, feature).select(feature, sample, F.log2(F.col("_p") / F.col("_r")).alias("m"), (F.log2(F.col("_p") * F.col("_r")) / 2).alias("a"))


# --- communities -----------------------------------------------------------------------------------------------------


def centred_log_ratio(df: DataFrame, sample: str, n: str, pseudo: float = 0.5) -> DataFrame:
    """Over the features that have rows; give zeros as rows for those that should count."""
    x = df.withColumn("_l", F.log(F.col(n) + pseudo))
    mean = x.groupBy(sample).agg(F.avg("_l").alias("_m"))
    return x.join(mean, sample).withColumn("clr", F.col("_l") - F.col("_m")).drop("_l", "_m")


def bray_curtis(df: DataFrame, feature: str, sample: str, n: str) -> DataFrame:
    """1 - 2 * shared / (total a + total b) for each pair of samples; only features that both have are joined."""
    totals = df.groupBy(sample).agg(F.sum(n).alias("t"))
    x = df.select(feature, F.col(sample).alias("a"), F.col(n).alias("x"))
    y = df.select(feature, F.col(sample).alias("b"), F.col(n).alias("y"))
    shared = x.join(y, feature).where("a < b").groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("w"))
    ta, tb = totals.toDF("a", "ta"), totals.toDF("b", "tb")
    pairs = ta.join(tb, F.col("a") < F.col("b"))  # samples, not features: the distance matrix itself
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", (1 - 2 * F.coalesce("w", F.lit(0)) / (F.col("ta") + F.col("tb"))).alias("distance"))


def kmer_votes(reads: DataFrame, database: DataFrame, read: str) -> DataFrame:
    """Each read's taxon by votes of its k-mers, the smallest of the most voted; reads (read, kmer), database (kmer, taxon)."""
    votes = reads.join(database, "kmer").groupBy(read, "taxon").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy(read).agg(F.min(F.struct((-F.col("n")).alias("k"), "taxon")).alias("t"))
    return reads.select(read).distinct().join(top, read, "left").select(read, F.coalesce("t.taxon", F.lit("unclassified")).alias("taxon"), F.coalesce(-F.col("t.k"), F.lit(0)).alias("votes"))


def pathway_totals(hits: DataFrame, mapping: DataFrame, feature: str, value: str) -> DataFrame:
    return hits.join(mapping, feature).groupBy("pathway").agg(F.sum(value).alias("abundance"))


def haplotypes(df: DataFrame, sample: str, position: str, allele: str) -> DataFrame:
    """'pos:allele' joined by | in order of position, for each sample; as long as a sample's own calls."""
    part = F.struct(F.col(position).alias("p"), F.col(allele).alias("a"))
    text = F.array_join(F.transform(F.array_sort(F.collect_set(part)), lambda s: F.concat(s["p"].cast("string"), F.lit(":"), s["a"])), "|")
    return df.groupBy(sample).agg(text.alias("haplotype"))


def lowest_common(votes: Column, vote_sep: str = "|", rank_sep: str = ";") -> Column:
    """The longest lineage that all votes begin with."""
    lines = F.transform(F.split(votes, f"\\{vote_sep}"), lambda v: F.split(v, rank_sep))
    meet = lambda a, b: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)), lambda i: F.element_at(a, i))
    return F.array_join(F.aggregate(F.slice(lines, 2, 1 << 20), F.element_at(lines, 1), lambda a, b: F.when(F.size(a) == 0, a).otherwise(meet(a, b))), rank_sep)


# --- peptides, metabolites -------------------------------------------------------------------------------------------


def top_sum(df: DataFrame, by: list[str], value: str, k: int = 3) -> DataFrame:
    """Sum of the k largest values of each group, and how many there are in all. Only k of a task's values of a group travel."""
    best = df.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(value), asc=False), 1, k).alias("_t"), F.count(F.lit(1)).alias("n"))
    return best.select(*by, F.aggregate("_t", F.lit(0.0), lambda a, x: a + x).alias("top"), "n")


def top_sum_ranked(df: DataFrame, by: list[str], value: str, k: int = 3) -> DataFrame:
    """top_sum for groups of any size: a rank limit below the window keeps k rows of each group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(*by).agg(F.sum(value).alias("top"))


def band_join(a: DataFrame, b: DataFrame, x: str, y: str, ppm: float) -> DataFrame:
    """Pairs with |x - y| <= y * ppm / 1e6, both positive: bins as wide as the tolerance at the bin's place, by logarithm."""
    step = F.lit(2 * ppm / 1e6).cast("double")
    bin_of = lambda c: F.floor(F.log(c) / step)
    near = a.withColumn("_b", F.explode(F.array(*[bin_of(F.col(x)) + d for d in (-1, 0, 1)])))
    return near.join(b.withColumn("_b", bin_of(F.col(y))), "_b").where(F.abs(F.col(x) - F.col(y)) <= F.col(y) * (ppm / 1e6)).drop("_b")


def coefficient_of_variation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")))


def median_deviation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation, in two passes."""
    mid = df.groupBy(*by).agg(F.median(value).alias("median"))
    return df.join(mid, by).groupBy(*by, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def sequon_sites(protein: Column) -> Column:
    """1-based places of N, not P, S or T; they may overlap."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(protein) - 2)), lambda i: F.substring(protein, i, F.lit(3)).rlike("^N[^P][ST]$"))


# --- cells -----------------------------------------------------------------------------------------------------------


def cell_metrics(df: DataFrame, cell: str, feature: str, n: str, mito: Column) -> DataFrame:
    total = F.sum(n)
    return df.groupBy(cell).agg(total.alias("total"), F.count_if(F.col(n) > 0).alias("features"), (F.sum(F.when(mito, F.col(n)).otherwise(0)) / total).alias("mito_share"))


def log_normalize(df: DataFrame, cell: str, n: str, scale: float = 1e4) -> DataFrame:
    return share(df, n, [cell], "_s").withColumn("value", F.log1p(F.col("_s") * scale)).drop("_s")


def variable_features(df: DataFrame, feature: str, value: str, n_cells: int, top: int) -> DataFrame:
    """Population mean and variance with absent rows as zeros, and the features of the largest variance over mean."""
    s = df.groupBy(feature).agg((F.sum(value) / n_cells).alias("mean"), (F.sum(F.col(value) * F.col(value)) / n_cells).alias("_q"))
    s = s.withColumn("variance", F.col("_q") - F.col("mean") * F.col("mean")).drop("_q").withColumn("ratio", F.col("variance") / F.col("mean"))
    return s.orderBy(F.desc("ratio"), feature).limit(top)


def pseudobulk(df: DataFrame, labels: DataFrame, cell: str, feature: str, n: str) -> DataFrame:
    return df.join(labels, cell).groupBy("label", feature).agg(F.sum(n).alias(n))


# --- gene sets -------------------------------------------------------------------------------------------------------


def over_representation(sets: DataFrame, query: DataFrame, universe: DataFrame, term: str = "term", gene: str = "gene") -> DataFrame:
    """Overlap of each set with the query within the universe, the odds ratio with 0.5 added, and the hypergeometric p-value."""
    known = universe.select(gene).distinct()
    q = query.select(gene).distinct().join(known, gene, "left_semi").withColumn("_in", F.lit(1))
    sizes = F.broadcast(known.agg(F.count(F.lit(1)).alias("n_universe")).crossJoin(q.agg(F.count(F.lit(1)).alias("n_query"))))
    s = sets.select(term, gene).distinct().join(known, gene, "left_semi").join(q, gene, "left").groupBy(term).agg(F.count(F.lit(1)).alias("n_set"), F.count("_in").alias("overlap")).crossJoin(sizes)
    a, b, c = F.col("overlap"), F.col("n_set") - F.col("overlap"), F.col("n_query") - F.col("overlap")
    d = F.col("n_universe") - F.col("n_set") - c
    s = s.withColumn("odds_ratio", ((a + 0.5) * (d + 0.5)) / ((b + 0.5) * (c + 0.5)))
    return s.withColumn("pvalue", stats.hypergeom_p(a, F.col("n_universe"), F.col("n_set"), F.col("n_query")))


def set_overlap(sets: DataFrame, term: str = "term", gene: str = "gene") -> DataFrame:
    """Jaccard index of each pair of sets that share a gene."""
    s = sets.select(term, gene).distinct()
    size = s.groupBy(term).agg(F.count(F.lit(1)).alias("n"))
    x, y = s.select(gene, F.col(term).alias("a")), s.select(gene, F.col(term).alias("b"))
    both = x.join(y, gene).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    return both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", "m", (F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).alias("jaccard"))


# --- peaks, methylation, long reads ----------------------------------------------------------------------------------


def methylation_levels(df: DataFrame, by: list[str], methylated: str, unmethylated: str, least: int = 1) -> DataFrame:
    m, u = F.sum(methylated), F.sum(unmethylated)
    return df.groupBy(*by).agg(m.alias("m"), u.alias("u")).where(F.col("m") + F.col("u") >= least).withColumn("level", F.col("m") / (F.col("m") + F.col("u")))


def n50(df: DataFrame, length: str, by: list[str]) -> DataFrame:
    """The largest length at which reads at least as long hold half of all bases: running sums over lengths, not reads. Rows without a group are one."""
    n = df.groupBy(*by, length).agg((F.count(F.lit(1)) * F.col(length)).alias("_b"))
    w = Window.partitionBy(*by)
    rows = n.withColumn("_c", F.sum("_b").over(w.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_b").over(w))
    return rows.where(F.col("_c") * 2 >= F.col("_t")).groupBy(*by).agg(F.max(length).alias("n50"))


def minimizers(kmers: DataFrame, key: str, window: int) -> DataFrame:
    """The smallest k-mer hash of each window of so many k-mers, and its place; runs of the same choice are one row. Rows: key, pos, kmer."""
    w = Window.partitionBy(key).orderBy("pos")
    best = F.min(F.struct(F.xxhash64("kmer").alias("h"), F.col("pos").alias("p"))).over(w.rowsBetween(0, window - 1))
    rows = kmers.withColumn("_m", best).withColumn("_left", F.lead("pos", window - 1).over(w)).where("_left is not null")
    return rows.select(key, F.col("_m.p").alias("pos"), F.col("_m.h").alias("hash")).distinct()


def contacts(df: DataFrame, read: str, place: str) -> DataFrame:
    """Counts of pairs of places that one read touches."""
    x = df.select(read, F.col(place).alias("a")).distinct()
    return x.join(x.select(read, F.col("a").alias("b")), read).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def nearest_gene(calls: DataFrame, genes: DataFrame, key: str) -> DataFrame:
    """The nearest gene of each point (chrom, pos), 0 inside; the smallest name of the nearest; 'intergenic' without genes.

    An as-of join: the gene containing the point, else the last that ends before it and the first that starts behind it.
    """
    from strandlake.operators.intervals import find_overlaps, follow, precede

    q = calls.select(key, "chrom", F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.lit(".").alias("strand"))
    s = genes.select("chrom", (F.col("start") + 1).alias("lo"), F.col("stop").alias("hi"), F.col("name").alias("strand"))
    hit = find_overlaps(q, s).select(key, F.lit(0).cast("long").alias("d"), F.col("s_strand").alias("g"))
    left = precede(q, s).where("s_hi is not null").select(key, (F.col("lo") - F.col("s_hi")).alias("d"), F.col("s_strand").alias("g"))
    right = follow(q, s).where("s_lo is not null").select(key, (F.col("s_lo") - F.col("hi")).alias("d"), F.col("s_strand").alias("g"))
    best = hit.union(left).union(right).groupBy(key).agg(F.min(F.struct("d", "g")).alias("b"))
    return calls.select(key).join(best, key, "left").select(key, F.coalesce("b.g", F.lit("intergenic")).alias("gene"), F.coalesce("b.d", F.lit(-1)).alias("distance"))
