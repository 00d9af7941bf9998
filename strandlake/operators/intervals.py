"""Region filters, bins, coverage, and interval algebra.

Two conventions are in use and never mixed: columns (start, stop) are 0-based and half-open, columns (lo, hi) 1-based
and closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.running import neighbour, running

#: Width of the bins in which a range join looks for partners: about the length of a typical interval.
JOIN_BIN = 256


# --- half-open -------------------------------------------------------------------------------------------------------


def filter_region(df: DataFrame, chrom: str, low: int, high: int) -> DataFrame:
    """Rows of a variant table with low <= pos <= high; both conditions reach the scan."""
    return df.where((F.col("chrom") == chrom) & F.col("pos").between(low, high)).select("chrom", "pos", "id", "ref", "alt", "qual")


def bin_positions(df: DataFrame, width: int, pos: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.floor(F.col(pos) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage_histogram(df: DataFrame, chrom: str, width: int) -> DataFrame:
    """Counts of positions of one chromosome by bin."""
    return bin_positions(df.where(F.col("chrom") == chrom), width)


def window_coverage(df: DataFrame, width: int, chrom: str | None = None) -> DataFrame:
    """Covered bases of each interval in each window it reaches, summed; only windows with any."""
    rows = df.where(F.col("stop") > F.col("start"))
    rows = rows.where(F.col("chrom") == chrom) if chrom else rows
    hit = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("window")
    inside = F.least("stop", (F.col("window") + 1) * width) - F.greatest("start", F.col("window") * width)
    return rows.select("chrom", "start", "stop", hit).groupBy("chrom", "window").agg(F.sum(inside).alias("covered"))


def normalize_interval(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("stop"))


def interval_length(start: Column, stop: Column) -> Column:
    return F.greatest(F.lit(0), stop - start)


def interval_contains(start: Column, stop: Column, pos: Column) -> Column:
    return (start <= pos) & (pos < stop)


def interval_overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(a, c) < F.least(b, d)


def interval_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when(interval_overlaps(a, b, c, d), F.struct(F.greatest(a, c).alias("start"), F.least(b, d).alias("stop")))


def interval_union(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Null unless the two overlap or touch."""
    return F.when(F.greatest(a, c) <= F.least(b, d), F.struct(F.least(a, c).alias("start"), F.greatest(b, d).alias("stop")))


def interval_difference(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Array of what is left of [a, b) without [c, d)."""
    left = F.struct(a.alias("start"), F.least(b, c).alias("stop"))
    right = F.struct(F.greatest(a, d).alias("start"), b.alias("stop"))
    whole = F.array(F.struct(a.alias("start"), b.alias("stop")))
    return F.when(~interval_overlaps(a, b, c, d), whole).otherwise(F.filter(F.array(left, right), lambda s: s["start"] < s["stop"]))


def islands(df: DataFrame, low: str, high: str, slack: int, by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Merged spans: rows join if low <= highest before + slack. Columns by, low, high, merged (rows in each).

    Nulls come last, and a row without low is a span of its own. Of rows that are alike the one that begins a span comes first.
    """
    order = [F.col(low), F.col(high).asc_nulls_last()]
    known = df.select(*by, low, high)
    alone = known.where(F.col(low).isNull()).select(*by, low, high, F.lit(1).cast("long").alias("merged"))
    rows = running(known.where(F.col(low).isNotNull()), list(by), low, order, F.col(high), "max", "_before", before_only=True)
    new = F.when(F.col("_before").isNull() | (F.col(low) > F.col("_before") + slack), 1).otherwise(0)
    rows = running(rows.withColumn("_new", new), list(by), low, [*order, F.col("_new").desc()], F.col("_new"), "sum", "_island")
    rows = rows.groupBy(*by, "_island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("merged")).drop("_island")
    return rows.unionByName(alone)


def merge_intervals(df: DataFrame) -> DataFrame:
    """Half-open intervals; touching ones merge. Empty ones are kept where nothing covers or touches them."""
    return islands(df, "start", "stop", 0).drop("merged")


def run_length(df: DataFrame, by: tuple[str, ...], position: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values at consecutive positions: by, start, stop (half-open), value. For signal sinks."""
    rows = neighbour(df, list(by), position, [position], F.struct(F.col(position).alias("at"), F.col(value).alias("is")), "_before", ahead=False)
    same = (F.col("_before.at") == F.col(position) - 1) & F.col("_before.is").eqNullSafe(F.col(value))
    rows = rows.withColumn("_new", F.when(same, 0).otherwise(1)).drop("_before")
    rows = running(rows, list(by), position, [position], F.col("_new"), "sum", "_run")
    return rows.groupBy(*by, "_run", value).agg(F.min(position).alias("start"), (F.max(position) + 1).alias("stop")).drop("_run")


# --- closed ----------------------------------------------------------------------------------------------------------


def shift(df: DataFrame, delta: int) -> DataFrame:
    return df.withColumns({"lo": F.col("lo") + delta, "hi": F.col("hi") + delta})


def flank(df: DataFrame, width: int, start: bool = True) -> DataFrame:
    """The stretch in front of the strand-aware start (or behind the end)."""
    left = F.col("strand") != "-" if start else F.col("strand") == "-"
    return df.withColumns({"lo": F.when(left, F.col("lo") - width).otherwise(F.col("hi") + 1), "hi": F.when(left, F.col("lo") - 1).otherwise(F.col("hi") + width)})


def resize(df: DataFrame, width: int, fix: str = "start") -> DataFrame:
    """Keeps the start, center or end, whatever the strand."""
    if fix == "start":
        return df.withColumn("hi", F.col("lo") + width - 1)
    if fix == "end":
        return df.withColumn("lo", F.col("hi") - width + 1)
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    low = middle - int((width - 1) // 2)
    return df.withColumns({"lo": low, "hi": low + width - 1})


def promoters(df: DataFrame, upstream: int, downstream: int) -> DataFrame:
    minus = F.col("strand") == "-"
    return df.withColumns({
        "lo": F.when(minus, F.col("hi") - downstream).otherwise(F.col("lo") - upstream),
        "hi": F.when(minus, F.col("hi") + upstream - 1).otherwise(F.col("lo") + downstream - 1),
    })


def narrow(df: DataFrame, start: int = 0, stop: int = 0) -> DataFrame:
    return df.withColumns({"lo": F.col("lo") + start, "hi": F.col("hi") - stop}).where(F.col("lo") <= F.col("hi"))


def trim(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Clips to [1, length]; intervals on chromosomes without a length go."""
    rows = df.join(lengths.select("chrom", F.col("length").alias("_len")), "chrom")
    return rows.withColumns({"lo": F.greatest("lo", F.lit(1)), "hi": F.least("hi", "_len")}).where("lo <= hi").drop("_len")


def reduce(df: DataFrame) -> DataFrame:
    """Merges overlapping and adjacent closed intervals of a chromosome, whatever their strand."""
    return islands(df, "lo", "hi", 1)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return reduce(a.select("chrom", "lo", "hi").unionByName(b.select("chrom", "lo", "hi")))


def coverage(df: DataFrame) -> DataFrame:
    """Segments of constant depth over 0."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e")
    events = df.select("chrom", ends).groupBy("chrom", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    rows = running(events, ["chrom"], "pos", ["pos"], F.col("d"), "sum", "depth")
    rows = neighbour(rows, ["chrom"], "pos", ["pos"], F.col("pos") - 1, "hi", ahead=True)
    return rows.where("depth > 0").select("chrom", F.col("pos").alias("lo"), "hi", "depth")


def gaps(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """What no interval covers of [1, length] of each chromosome; chromosomes without intervals are one gap."""
    spans = reduce(df).select("chrom", "lo", "hi").unionByName(lengths.select("chrom", (F.col("length") + 1).alias("lo"), (F.col("length") + 1).alias("hi")))
    spans = neighbour(spans, ["chrom"], "lo", ["lo", "hi"], F.col("hi"), "_before", ahead=False)
    rows = spans.select("chrom", (F.coalesce("_before", F.lit(0)) + 1).alias("_lo"), (F.col("lo") - 1).alias("_hi"))
    rows = rows.join(lengths, "chrom").select("chrom", F.col("_lo").alias("lo"), F.least("_hi", "length").alias("hi"))
    return rows.where("lo <= hi")


def disjoin(df: DataFrame) -> DataFrame:
    """The pieces that all ends cut the covered stretches into."""
    cuts = df.select("chrom", F.explode(F.array("lo", F.col("hi") + 1)).alias("lo")).distinct()
    pieces = neighbour(cuts, ["chrom"], "lo", ["lo"], F.col("lo") - 1, "hi", ahead=True).where("hi is not null")
    spans = reduce(df).select("chrom", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return range_join(pieces, spans, ("lo", "hi"), ("_lo", "_hi")).select("chrom", "lo", "hi")


def range_join(a: DataFrame, b: DataFrame, ends_a: tuple[str, str] = ("lo", "hi"), ends_b: tuple[str, str] = ("lo", "hi"), closed: bool = True, how: str = "inner", width: int = JOIN_BIN) -> DataFrame:
    """Rows of a and b on one chromosome that overlap. Columns of the two must differ but for chrom.

    Both sides are filed under each bin that they reach and meet by (chrom, bin); a pair comes out in one bin only, that
    of the later of its two starts, so nothing has to be made distinct. 'left' keeps rows of a without partner,
    those with a null in chrom or an end among them; nulls in other columns are values like any other.
    """
    (al, ah), (bl, bh) = ends_a, ends_b
    last = 0 if closed else 1

    def filed(df: DataFrame, low: str, high: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col(low) / width), F.greatest(F.floor(F.col(low) / width), F.floor((F.col(high) - last) / width)))
        return df.withColumn("_bin", F.explode(bins))

    meet = (F.col(al) <= F.col(bh)) & (F.col(bl) <= F.col(ah)) if closed else (F.col(al) < F.col(bh)) & (F.col(bl) < F.col(ah))
    once = F.col("_bin") == F.floor(F.greatest(al, bl) / width)
    if how == "inner":
        return filed(a, al, ah).join(filed(b, bl, bh), ["chrom", "_bin"]).where(meet & once).drop("_bin")
    pairs = range_join(a, b, ends_a, ends_b, closed, "inner", width)
    whole = F.struct(*a.columns)
    met = pairs.select(whole.alias("_met")).distinct()
    alone = a.withColumn("_row", whole).join(met, F.col("_row").eqNullSafe(F.col("_met")), "left_anti").drop("_row")
    return pairs.unionByName(alone, allowMissingColumns=True)


def find_overlaps(query: DataFrame, subject: DataFrame) -> DataFrame:
    """Pairs of a query range and a subject range that overlap; the subject's columns get the prefix s_."""
    other = subject.select("chrom", *[F.col(c).alias(f"s_{c}") for c in subject.columns if c != "chrom"])
    return range_join(query, other, ("lo", "hi"), ("s_lo", "s_hi"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common part of each overlapping pair; parts may repeat or overlap."""
    return find_overlaps(a, b).select("chrom", F.greatest("lo", "s_lo").alias("lo"), F.least("hi", "s_hi").alias("hi"))


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is left of each row of a (its strand stays) without all of b."""
    blocks = reduce(b).select("chrom", F.col("lo").alias("_bl"), F.col("hi").alias("_bh"))
    hit = range_join(a, blocks, ("lo", "hi"), ("_bl", "_bh"))
    cut = hit.groupBy("chrom", "lo", "hi", "strand").agg(F.array_sort(F.collect_list(F.struct("_bl", "_bh"))).alias("cuts"))
    n = F.size("cuts")
    low = lambda i: F.when(i == 0, F.col("lo")).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["_bh"] + 1)
    high = lambda i: F.when(i == n, F.col("hi")).otherwise(F.element_at("cuts", F.least(i + 1, n))["_bl"] - 1)
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(low(i).alias("a"), high(i).alias("b")))
    left = cut.select("chrom", "strand", F.explode(F.filter(pieces, lambda s: s["a"] <= s["b"])).alias("p")).select("chrom", F.col("p.a").alias("lo"), F.col("p.b").alias("hi"), "strand")
    alone = a.select("chrom", "lo", "hi", "strand").join(hit.select("chrom", "lo", "hi", "strand").distinct(), ["chrom", "lo", "hi", "strand"], "left_anti")
    return left.unionByName(alone)


def _beside(query: DataFrame, subject: DataFrame, left: bool) -> DataFrame:
    """For each query range the nearest subject range that ends before it (or begins behind it): an as-of join by bins."""
    pos_q = F.col("lo") if left else -F.col("hi")
    pos_s, best = (F.col("hi"), F.struct(F.col("hi").alias("k"), F.col("lo").alias("b"), F.col("strand").alias("s"))) if left else (-F.col("lo"), F.struct((-F.col("lo")).alias("k"), (-F.col("hi")).alias("b"), F.col("strand").alias("s")))
    kind = subject.select(best.alias("x")).schema["x"].dataType
    q = query.select("chrom", pos_q.alias("_p"), F.lit(0).alias("_order"), F.lit(None).cast(kind).alias("_s"), F.struct(*query.columns).alias("_q"))
    s = subject.select("chrom", pos_s.alias("_p"), F.lit(1).alias("_order"), best.alias("_s"), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"))
    rows = running(q.unionByName(s), ["chrom"], "_p", ["_p", "_order"], F.col("_s"), "max", "_best")
    rows = rows.where("_order = 0").select("_q.*", "_best")
    sign = 1 if left else -1
    lo, hi = (F.col("_best.b"), F.col("_best.k")) if left else (F.col("_best.k") * sign, F.col("_best.b") * sign)
    return rows.select(*query.columns, lo.alias("s_lo"), hi.alias("s_hi"), F.col("_best.s").alias("s_strand"))


def precede(query: DataFrame, subject: DataFrame) -> DataFrame:
    """The nearest subject range wholly to the left of each query range, whatever the strands: the largest (hi, lo, strand)."""
    return _beside(query, subject, True)


def follow(query: DataFrame, subject: DataFrame) -> DataFrame:
    """The nearest subject range wholly to the right of each query range: the smallest (lo, hi), then the largest strand."""
    return _beside(query, subject, False)


def distance(query: DataFrame, subject: DataFrame) -> DataFrame:
    """Bases between each query range and the nearest subject range, 0 if one overlaps, -1 if its chromosome has none."""
    hits = find_overlaps(query, subject).select(*query.columns).distinct().withColumn("_hit", F.lit(0))
    sides = precede(query, subject).select(*query.columns, F.col("s_hi").alias("_l")).join(follow(query, subject).select(*query.columns, F.col("s_lo").alias("_r")), query.columns)
    rows = sides.join(hits, query.columns, "left")
    near = F.least(F.col("lo") - F.col("_l") - 1, F.col("_r") - F.col("hi") - 1)
    return rows.select(*query.columns, F.coalesce("_hit", near, F.lit(-1)).alias("distance"))


def nearest(query: DataFrame, subject: DataFrame) -> DataFrame:
    """One subject range a query range: an overlapping one (smallest lo, hi, strand), else the one before, else the one behind."""
    best = find_overlaps(query, subject).groupBy(*query.columns).agg(F.min(F.struct("s_lo", "s_hi", "s_strand")).alias("b"))
    over = best.select(*query.columns, F.col("b.*"))
    rest = query.join(over.select(*query.columns), query.columns, "left_anti")
    before = precede(rest, subject)
    behind = follow(before.where("s_lo is null").select(*query.columns), subject)
    return over.unionByName(before.where("s_lo is not null")).unionByName(behind)


def parallel_pairs(a: DataFrame, b: DataFrame, key: str = "row") -> DataFrame:
    """Row-wise intersection, hull and difference of two tables with a common row number."""
    rows = a.select(key, "chrom", "lo", "hi").join(b.select(key, F.col("chrom").alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), key)
    same = F.col("chrom") == F.col("c2")
    meet = same & (F.greatest("lo", "lo2") <= F.least("hi", "hi2"))
    pieces = F.filter(F.array(F.struct(F.col("lo").alias("lo"), (F.col("lo2") - 1).alias("hi")), F.struct((F.col("hi2") + 1).alias("lo"), F.col("hi").alias("hi"))), lambda s: s["lo"] <= s["hi"])
    return rows.select(
        key, F.when(meet, F.greatest("lo", "lo2")).alias("int_lo"), F.when(meet, F.least("hi", "hi2")).alias("int_hi"),
        F.when(same, F.least("lo", "lo2")).alias("hull_lo"), F.when(same, F.greatest("hi", "hi2")).alias("hull_hi"),
        F.when(meet, F.size(pieces)).otherwise(1).alias("n_diff"), F.when(meet, F.aggregate(F.transform(pieces, lambda s: s["hi"] - s["lo"] + 1), F.lit(0).cast("long"), lambda x, y: x + y)).otherwise(F.col("hi") - F.col("lo") + 1).alias("diff_bases"),
    )


def count_features(reads: DataFrame, features: DataFrame, name: str = "name") -> DataFrame:
    """How many reads overlap each feature (half-open); features without reads count 0."""
    hits = range_join(features.select("chrom", "start", "stop", name), reads.select("chrom", F.col("start").alias("r_start"), F.col("stop").alias("r_stop")), ("start", "stop"), ("r_start", "r_stop"), closed=False)
    n = hits.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return features.select(name).join(n, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def annotate(variants: DataFrame, features: DataFrame, rank: Column | None = None) -> DataFrame:
    """Each variant with the feature (half-open, 0-based) of the highest rank that it lies in, and the number of features; null and 0 if none.

    rank is a column of features, all equal if None; of equal ranks the smallest name counts.
    """
    v = variants.select("id", "chrom", (F.col("pos") - 1).alias("v_start"), F.col("pos").alias("v_stop"))
    f = features.select("chrom", "start", "stop", "name", (F.lit(0) if rank is None else -rank).alias("_low"))
    hits = range_join(v, f, ("v_start", "v_stop"), ("start", "stop"), closed=False).groupBy("id").agg(F.min(F.struct("_low", "name")).alias("_best"), F.count(F.lit(1)).alias("n"))
    return variants.select("id").join(hits, "id", "left").select("id", F.col("_best.name").alias("feature"), (-F.col("_best._low")).alias("rank"), F.coalesce("n", F.lit(0)).alias("n_features"))
