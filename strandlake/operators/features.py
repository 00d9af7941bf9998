"""Feature locations, their sequences, and restriction digests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import reverse_complement

# Recognition sites and the offset of the cut on the upper strand.
ENZYMES = {"EcoRI": ("GAATTC", 1), "BamHI": ("GGATCC", 1), "HindIII": ("AAGCTT", 1), "EcoRV": ("GATATC", 3), "AluI": ("AGCT", 2), "HaeIII": ("GGCC", 2), "TaqI": ("TCGA", 1), "MseI": ("TTAA", 1)}


def spans(location: Column) -> Column:
    """array<struct<start, stop>> of a location such as complement(join(1..5,8..10)); a lone number is a span of one."""
    parts = F.regexp_extract_all(location, F.lit(r"<?(\d+)(?:\.\.>?\d+)?"), F.lit(0))
    clean = lambda p: F.regexp_replace(p, "[<>]", "")
    return F.transform(parts, lambda p: F.struct(F.split(clean(p), r"\.\.")[0].cast("int").alias("start"), F.element_at(F.split(clean(p), r"\.\."), -1).cast("int").alias("stop")))


def strand(location: Column) -> Column:
    return F.when(location.startswith("complement("), "-").otherwise("+")


def bounds(location: Column) -> Column:
    s = spans(location)
    return F.struct(F.array_min(F.transform(s, lambda x: x["start"])).alias("start"), F.array_max(F.transform(s, lambda x: x["stop"])).alias("stop"))


def extract(seq: Column, location: Column) -> Column:
    """The spans' letters joined; of a complement, the reverse complement."""
    whole = F.array_join(F.transform(spans(location), lambda s: F.substring(seq, s["start"], s["stop"] - s["start"] + 1)), "")
    return F.when(strand(location) == "-", reverse_complement(whole)).otherwise(whole)


def holds(location: Column, pos: Column) -> Column:
    return F.exists(spans(location), lambda s: (s["start"] <= pos) & (pos <= s["stop"]))


def fragments(df: DataFrame, key: str, seq: str, enzyme: str) -> DataFrame:
    """Pieces that an enzyme cuts each sequence into: key, no, start, size. Cuts at the first base don't count; there is one piece at least."""
    site, offset = ENZYMES[enzyme]
    marked = F.split(F.regexp_replace(F.col(seq), f"(?={site[1:]})(?<={site[0]})", "|"), r"\|")
    # Lengths up to each mark; a mark stands behind a site's first letter, and the cut is `offset` behind its beginning.
    ends = F.aggregate(F.slice(marked, 1, F.greatest(F.size(marked) - 1, F.lit(0))), F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    cuts = F.filter(F.transform(F.slice(ends, 2, 1 << 30), lambda e: e - 1 + offset), lambda c: c >= 1)
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(F.length(seq)))
    rows = df.select(key, edges.alias("e")).select(key, "e", F.posexplode(F.slice("e", 1, F.size("e") - 1)).alias("no", "start"))
    return rows.select(key, "no", F.col("start"), (F.element_at("e", F.col("no") + 2) - F.col("start")).alias("size"))
