"""Labels and scores that tables of fixed values give: consequences, tiers, alleles, phenotypes, binding and composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import count_of
from strandlake.operators.running import running
from strandlake.operators.structure import lookup

# Fixed values.
SEVERITY = {"stop_gained": 5, "frameshift_variant": 5, "missense_variant": 4, "splice_region_variant": 3, "synonymous_variant": 2, "intron_variant": 1}
TIERS = {
    "stop_gained": 1, "frameshift_variant": 1, "start_lost": 1, "stop_lost": 1, "missense_variant": 2, "splice_region_variant": 2, "splice_acceptor_variant": 2, "splice_donor_variant": 2,
    "inframe_insertion": 3, "inframe_deletion": 3, "synonymous_variant": 4, "intron_variant": 4, "intergenic_variant": 4,
}
STAR_ALLELES = {"CYP2D6:rs1065852": "*10", "CYP2D6:rs3892097": "*4", "CYP2D6:rs16947": "*2", "CYP2C19:rs4244285": "*2", "CYP2C19:rs12248560": "*17"}
ACTIVITY = {"*1": 1.0, "*2": 1.0, "*4": 0.0, "*5": 0.0, "*10": 0.25, "*17": 0.5, "*41": 0.5}
IUPAC = {"W": "[AT]", "R": "[AG]", "Y": "[CT]", "S": "[GC]", "K": "[GT]", "M": "[AC]", "B": "[CGT]", "D": "[AGT]", "H": "[ACT]", "V": "[ACG]", "N": "[ACGT]"}
HOTSPOTS = ("WRC", "GYW", "WA", "TW")
VIRAL = ("TATA", "AATAAA", "TTTT")


def severity(consequence: Column) -> Column:
    return lookup(SEVERITY, consequence, 0)


def impact(consequence: Column) -> Column:
    s = severity(consequence)
    return F.when(s >= 5, "HIGH").when(s >= 3, "MODERATE").otherwise("LOW")


def tier(consequence: Column) -> Column:
    return lookup(TIERS, consequence, 3)


def tier_label(consequence: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("Tier_I", "Tier_II", "Tier_III", "Tier_IV"))), tier(consequence))


def star_allele(gene: Column, variant: Column) -> Column:
    return lookup(STAR_ALLELES, F.concat_ws(":", gene, variant), "unknown")


def activity(diplotype: Column) -> Column:
    """Sum of the alleles' activities, 0.5 for unknown ones; + is read as /."""
    return F.aggregate(F.split(F.replace(diplotype, F.lit("+"), F.lit("/")), "/"), F.lit(0.0), lambda s, a: s + lookup(ACTIVITY, F.trim(a), 0.5))


def metabolizer(score: Column) -> Column:
    return F.when(score > 2, "ultrarapid_metabolizer").when(score >= 1.25, "normal_metabolizer").when(score >= 0.25, "intermediate_metabolizer").otherwise("poor_metabolizer")


def anchor_score(peptide: Column) -> Column:
    """Binding by the second and ninth residues and the length."""
    p, n = F.upper(peptide), F.length(peptide)
    at = lambda i, ok: F.when(n >= i, F.when(F.substring(p, i, 1).isin(*ok), 1.0).otherwise(-0.5)).otherwise(0.0)
    return at(2, "LVIM") + at(9, "LVI") + F.when(n == 9, 0.5).otherwise(-0.25 * F.abs(n - 9))


def motif_hits(seq: Column, motifs: tuple[str, ...]) -> Column:
    """Places, overlapping ones too, at which motifs of IUPAC letters stand."""
    pattern = lambda m: "(?=" + "".join(IUPAC.get(c, c) for c in m) + ")"
    return sum((F.regexp_count(F.upper(seq), F.lit(pattern(m))) for m in motifs), F.lit(0))


def viral_score(seq: Column) -> Column:
    """Half the G and C share, half a saturating count of motifs (not overlapping themselves)."""
    s = F.upper(seq)
    hits = sum((F.regexp_count(s, F.lit(m)) for m in VIRAL), F.lit(0))
    return 0.5 * count_of(s, "GC") / F.greatest(F.length(s), F.lit(1)) + 0.5 * F.tanh(hits / 5)


def strain_variant(ref: Column, alt: Column, min_depth: int = 10, min_share: float = 0.02) -> Column:
    depth = ref + alt
    return (depth >= min_depth) & (alt / F.greatest(depth, F.lit(1)) >= min_share)


def mutation_rate(seq: Column, germline: Column) -> Column:
    """Mismatches over the common length."""
    n = F.least(F.length(seq), F.length(germline))
    pairs = F.zip_with(F.split(F.substring(seq, F.lit(1), n), ""), F.split(F.substring(germline, F.lit(1), n), ""), lambda a, b: F.when(a == b, 0).otherwise(1))
    return F.when(n > 0, F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / n).otherwise(0.0)


def roc(df: DataFrame, event: Column, control: Column, marker: str) -> DataFrame:
    """Rates at each threshold from the largest on, from counts by marker value: threshold, tpr, fpr, area (up to it)."""
    n = df.groupBy(F.col(marker).alias("threshold")).agg(F.count_if(event).alias("e"), F.count_if(control).alias("c")).where("e + c > 0").withColumn("_d", -F.col("threshold"))
    n = running(running(n, [], "_d", ["_d"], F.col("e"), "sum", "_e"), [], "_d", ["_d"], F.col("c"), "sum", "_c")
    t = F.broadcast(df.agg(F.count_if(event).alias("_te"), F.count_if(control).alias("_tc")))
    n = n.crossJoin(t).withColumns({"tpr": F.when(F.col("_te") > 0, F.col("_e") / F.col("_te")).otherwise(0.0), "fpr": F.when(F.col("_tc") > 0, F.col("_c") / F.col("_tc")).otherwise(0.0)})
    step = F.when(F.col("_tc") > 0, F.col("c") / F.col("_tc")).otherwise(0.0)
    mean = F.col("tpr") - F.when(F.col("_te") > 0, F.col("e") / F.col("_te") / 2).otherwise(0.0)
    return running(n.withColumn("_a", step * mean), [], "_d", ["_d"], F.col("_a"), "sum", "area").select("threshold", "tpr", "fpr", "area")


def copy_number(df: DataFrame, by: list[str], place: str, depth: str, window: int = 50, gain: float = 0.3, loss: float = -0.3) -> DataFrame:
    """Rolling median over its mean, as log2 ratio, and gain, loss or neutral."""
    w = Window.partitionBy(*by).orderBy(place).rowsBetween(-(window // 2), window // 2)
    x = df.withColumn("_s", F.percentile(depth, F.lit(0.5)).over(w))
    mean = x.groupBy(*by).agg(F.avg("_s").alias("_m"))
    x = (x.join(mean, by) if by else x.crossJoin(F.broadcast(mean))).withColumn("log2_ratio", F.log2(F.greatest(F.col("_s") / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0), F.lit(1e-6))))
    return x.withColumn("call", F.when(F.col("log2_ratio") >= gain, "gain").when(F.col("log2_ratio") <= loss, "loss").otherwise("neutral")).drop("_s", "_m")
