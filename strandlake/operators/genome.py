"""Aligned sequences, populations, motifs, guides and long-read evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as sq

# --- aligned sequences: rows (key, seq) of equal length --------------------------------------------------------------


def site_counts(df: DataFrame, seq: str = "seq", letters: str = "ACGT") -> DataFrame:
    """How often each letter stands in each column: pos, sym, n."""
    rows = sq.kmers(df.select(seq), seq, 1)
    return rows.where(F.col("kmer").isin(*letters)).groupBy("pos", F.col("kmer").alias("sym")).agg(F.count(F.lit(1)).alias("n"))


def site_summary(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Of each column: letters, sequences, the rarest letter's count, and the share of pairs that differ."""
    c = site_counts(df, seq)
    s = c.groupBy("pos").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"), F.min("n").alias("rarest"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    t = F.col("total")
    return s.withColumn("differing", F.when(t > 1, (t * t - F.col("_q")) / (t * (t - 1))).otherwise(0.0)).drop("_q")


def diversity_statistics(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: sequences, length, segregating sites, pi (a site), Watterson's theta (a site), Tajima's D.

    The mean number of differences of a pair is a sum over columns of letter counts, so no pairs of sequences are made.
    """
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.length(seq)).alias("length"))
    s = site_summary(df, seq).agg(F.count_if(F.col("kinds") > 1).alias("segregating"), F.coalesce(F.sum("differing"), F.lit(0.0)).alias("k"))
    x = size.crossJoin(s)
    n = F.col("n").cast("double")
    steps = F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)))
    a1 = F.aggregate(steps, F.lit(0.0), lambda a, i: a + 1.0 / i)
    a2 = F.aggregate(steps, F.lit(0.0), lambda a, i: a + 1.0 / (i * i))
    x = x.withColumns({"a1": a1, "a2": a2})
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / F.col("a1"), b2 - (n + 2) / (F.col("a1") * n) + F.col("a2") / (F.col("a1") * F.col("a1"))
    e1, e2 = c1 / F.col("a1"), c2 / (F.col("a1") * F.col("a1") + F.col("a2"))
    seg = F.col("segregating")
    d = (F.col("k") - seg / F.col("a1")) / F.sqrt(e1 * seg + e2 * seg * (seg - 1))
    return x.select("n", "length", "segregating", (F.col("k") / F.col("length")).alias("pi"), (seg / F.col("a1") / F.col("length")).alias("theta"), F.when((seg > 0) & (n > 3), d).otherwise(0.0).alias("tajima_d"))


def site_spectrum(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Folded spectrum: how many two-letter columns have each count of the rarer letter."""
    return site_summary(df, seq).where("kinds = 2").groupBy(F.col("rarest").alias("minor")).agg(F.count(F.lit(1)).alias("sites"))


def consensus(df: DataFrame, seq: str = "seq", least: float = 0.5) -> DataFrame:
    """The commonest letter of each column (the smallest of the commonest), N if its share is under the least."""
    c = site_counts(df, seq)
    s = c.groupBy("pos").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("k"), "sym")).alias("b"))
    return s.select("pos", F.when(-F.col("b.k") / F.col("t") >= least, F.col("b.sym")).otherwise("N").alias("letter"))


# --- allele frequencies of populations: rows (pop, snp, p) -----------------------------------------------------------


def frequencies(df: DataFrame) -> DataFrame:
    return df.where("dosage is not null").groupBy("pop", "snp").agg((F.avg("dosage") / 2).alias("p"), F.count(F.lit(1)).alias("n"))


def _side_by_side(p: DataFrame, pops: list) -> DataFrame:
    """One row a variant that all the populations have: p0, p1, …"""
    wide = p.where(F.col("pop").isin(*pops)).groupBy("snp").agg(*[F.max(F.when(F.col("pop") == x, F.col("p"))).alias(f"p{i}") for i, x in enumerate(pops)])
    return wide.na.drop()


def f_statistics_of_trees(p: DataFrame, pops: list) -> DataFrame:
    """f3(p2; p0, p1), f4(p0, p1; p2, p3) and Patterson's D over all variants that four populations share."""
    w = _side_by_side(p, pops)
    a, b, c, d = (F.col(f"p{i}") for i in range(4))
    abba, baba = (1 - a) * b * c * (1 - d), a * (1 - b) * c * (1 - d)
    return w.agg(F.avg((c - a) * (c - b)).alias("f3"), F.avg((a - b) * (c - d)).alias("f4"), (F.sum(abba - baba) / F.sum(abba + baba)).alias("d"), F.count(F.lit(1)).alias("n"))


def nei_distance(p: DataFrame) -> DataFrame:
    """Nei's distance of each pair of populations over two-allele variants."""
    x = p.select("snp", F.col("pop").alias("a"), F.col("p").alias("x"))
    y = p.select("snp", F.col("pop").alias("b"), F.col("p").alias("y"))
    same = lambda u, v: u * v + (1 - u) * (1 - v)
    s = x.join(y, "snp").where("a < b").groupBy("a", "b").agg(F.sum(same(F.col("x"), F.col("y"))).alias("xy"), F.sum(same(F.col("x"), F.col("x"))).alias("xx"), F.sum(same(F.col("y"), F.col("y"))).alias("yy"))
    return s.select("a", "b", (-F.log(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))).alias("distance"))


def differentiation(p: DataFrame) -> DataFrame:
    """Nei's Gst and Jost's D of each variant, populations of equal weight."""
    s = p.groupBy("snp").agg(F.avg("p").alias("m"), F.avg(2 * F.col("p") * (1 - F.col("p"))).alias("hs"), F.count(F.lit(1)).alias("k"))
    ht, hs, k = 2 * F.col("m") * (1 - F.col("m")), F.col("hs"), F.col("k")
    gst = F.when(ht > 0, (ht - hs) / ht).otherwise(0.0)
    return s.where("k > 1").select("snp", gst.alias("gst"), F.when(hs < 1, (ht - hs) / (1 - hs) * k / (k - 1)).otherwise(0.0).alias("jost_d"))


# --- motifs ----------------------------------------------------------------------------------------------------------


def frequency_matrix(counts: DataFrame, pseudo: float = 0.0, letters: str = "ACGT") -> DataFrame:
    """Share of each letter at each place, from rows (pos, sym, n); letters that are absent count, too."""
    wide = counts.groupBy("pos").agg(*[F.coalesce(F.sum(F.when(F.col("sym") == x, F.col("n"))), F.lit(0)).alias(x) for x in letters])
    total = sum((F.col(x) for x in letters), F.lit(len(letters) * pseudo))
    return wide.select("pos", *[((F.col(x) + pseudo) / total).alias(x) for x in letters])


def matrix_entropy(matrix: DataFrame, letters: str = "ACGT") -> DataFrame:
    """Entropy and information (bits) of each place, against a uniform background."""
    h = sum((F.when(F.col(x) > 0, -F.col(x) * F.log2(x)).otherwise(0.0) for x in letters), F.lit(0.0))
    return matrix.select("pos", h.alias("entropy"), (math.log2(len(letters)) - h).alias("information"))


def scan(df: DataFrame, seq: str, weights: list[dict[str, float]], threshold: float) -> DataFrame:
    """Places on both strands where the sum of a matrix' weights reaches the threshold: pos, strand, score."""
    hits = sq.kmers(df, seq, len(weights))
    score = lambda s: sum((F.coalesce(*[F.when(F.substring(s, i + 1, 1) == x, F.lit(w)) for x, w in col.items()], F.lit(float("-inf"))) for i, col in enumerate(weights)), F.lit(0.0))
    rc = F.reverse(F.translate("kmer", "ACGT", "TGCA"))
    both = F.array(F.struct(F.lit("+").alias("strand"), score(F.col("kmer")).alias("score")), F.struct(F.lit("-").alias("strand"), score(rc).alias("score")))
    keep = [c for c in hits.columns if c != "kmer"]
    return hits.select(*keep, F.inline(both)).where(F.col("score") >= threshold)


# --- guides ----------------------------------------------------------------------------------------------------------


def off_targets(df: DataFrame, seq: str, guide: str, most: int = 3) -> DataFrame:
    """Places on both strands that differ from a guide in few letters and have NGG behind them."""
    n = len(guide)
    hits = sq.kmers(df, seq, n + 3)
    bad = lambda s: sum((F.when(F.substring(s, i + 1, 1) == x, 0).otherwise(1) for i, x in enumerate(guide)), F.lit(0))
    rc = F.reverse(F.translate("kmer", "ACGT", "TGCA"))
    both = F.array(*[F.struct(F.lit(s).alias("strand"), F.substring(x, 1, n).alias("site"), bad(x).alias("mismatches"), F.substring(x, n + 2, 2).alias("pam")) for s, x in (("+", F.col("kmer")), ("-", rc))])
    keep = [c for c in hits.columns if c != "kmer"]
    return hits.select(*keep, F.inline(both)).where((F.col("mismatches") <= most) & (F.col("pam") == "GG")).drop("pam")


def rank_guides(df: DataFrame, efficiency: Column, specificity: Column, gc: Column, by: list[str], key: str) -> DataFrame:
    score = 0.6 * efficiency + 0.3 * F.coalesce(specificity, F.lit(0.5)) + 0.1 * (1 - F.abs(gc - 0.5) / 0.5)
    scored = df.withColumn("rank_score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rank_score"), key)))


def screen_fold_change(df: DataFrame, guide: str, gene: str, treated: str, control: str, pseudo: float = 1.0) -> DataFrame:
    """Reads a million with a pseudocount before dividing by the raw total, log2 fold change of guides, and a gene's mean, median and count."""
    t = F.broadcast(df.agg(F.sum(treated).alias("_t"), F.sum(control).alias("_c")))
    g = df.crossJoin(t).withColumn("lfc", F.log2(((F.col(treated) + pseudo) / F.col("_t")) / ((F.col(control) + pseudo) / F.col("_c"))))
    return g.groupBy(gene).agg(F.count(F.lit(1)).alias("n_guides"), F.avg("lfc").alias("mean_lfc"), F.median("lfc").alias("median_lfc"))


# --- long reads ------------------------------------------------------------------------------------------------------


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len int, op string>>."""
    parts = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.substring(p, 1, F.length(p) - 1).cast("int").alias("len"), F.substring(p, F.length(p), F.lit(1)).alias("op")))


def cigar_events(df: DataFrame, key: str, pos: str, cigar: str, least: int = 30) -> DataFrame:
    """Insertions and deletions of at least so many bases: key, kind, start (0-based on the reference), size."""
    step = lambda a, o: F.struct(
        (a["at"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["len"]).otherwise(0)).alias("at"),
        F.when(o["op"].isin("I", "D") & (o["len"] >= least), F.concat(a["found"], F.array(F.struct(F.when(o["op"] == "I", "INS").otherwise("DEL").alias("kind"), a["at"].alias("start"), o["len"].alias("size"))))).otherwise(a["found"]).alias("found"),
    )
    start = F.struct(F.col(pos).cast("long").alias("at"), F.expr("cast(array() as array<struct<kind: string, start: bigint, size: int>>)").alias("found"))
    return df.select(key, F.inline(F.aggregate(cigar_ops(F.col(cigar)), start, step)["found"]))


def discordant(df: DataFrame, mean: float = 500.0, sd: float = 100.0, z: float = 3.0) -> Column:
    """Kind of a read pair: on two chromosomes TRA, both on one strand INV, far apart DEL, too near INS; null if it is as expected."""
    size = F.abs(F.col("template_length"))
    flag = F.col("flag")
    same = (flag.bitwiseAND(F.lit(0x10)) != 0) == (flag.bitwiseAND(F.lit(0x20)) != 0)
    return F.when(F.col("refname") != F.col("mate_refname"), "TRA").when(same, "INV").when(size > mean + z * sd, "DEL").when((size > 0) & (size < mean - z * sd), "INS")


def cluster_events(df: DataFrame, by: list[str], pos: str, read: str, window: int = 100, least: int = 2) -> DataFrame:
    """Events whose neighbours are at most a window apart are one; those of enough different reads stay."""
    from strandlake.operators.running import running

    rows = running(df, by, pos, [pos, read], F.col(pos), "max", "_before", before_only=True)
    rows = rows.withColumn("_new", F.when(F.col("_before").isNull() | (F.col(pos) - F.col("_before") > window), 1).otherwise(0))
    rows = running(rows, by, pos, [pos, read], F.col("_new"), "sum", "_k")
    return rows.groupBy(*by, "_k").agg(F.count_distinct(read).alias("support"), F.min(pos).alias("first"), F.max(pos).alias("last")).where(F.col("support") >= least).drop("_k")


def candidate_regions(reads: DataFrame, index: DataFrame, key: str, most: int = 100) -> DataFrame:
    """Votes of shared hashes for each place (chrom, reference pos - read pos). Of a hash, the first `most` places by (chrom, pos) are seeds.

    Spark filters the ranks of a group before it shuffles, so a frequent hash sends at most that many rows a task.
    """
    first = Window.partitionBy("hash").orderBy("chrom", "pos")
    seeds = index.select("hash", "chrom", "pos").withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    return reads.join(seeds.select("hash", "chrom", F.col("pos").alias("_p")), "hash").groupBy(key, "chrom", (F.col("_p") - F.col("pos")).alias("start")).agg(F.count(F.lit(1)).alias("support"))
