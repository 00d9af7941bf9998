"""Queries of region filters, coverage and interval algebra over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import intervals as iv
from strandlake.operators.labels import severity
from strandlake.plans.views import duck, query, view

LENGTHS = "SELECT 'chr' || CAST(r AS STRING) AS chrom, CAST(15000 + 1000 * r AS BIGINT) AS length FROM (SELECT DISTINCT s_suppkey % 23 + 1 AS r FROM supplier)"
#: Every 7th range, as the smaller side of pairs.
SOME = "SELECT DISTINCT chrom, start + 1 AS lo, stop AS hi, strand FROM intervals WHERE start % 7 = 0"
GENE_RANGES = "SELECT chrom, start + 1 AS lo, stop AS hi, strand FROM genes"
PAIR = "SELECT DISTINCT start AS a, stop AS b, start + 20 AS c, start + 20 + CAST(floor((stop - start) / 2) AS BIGINT) AS d FROM intervals"
QUERIES, ORACLE_SQL = {}, {}


def register(name, sql, run):
    QUERIES[name], ORACLE_SQL[name] = run, duck(sql)


def one(name, source, operator, sql):
    """An operator on one view or SELECT."""
    text = source if " " in source else f"SELECT * FROM {source}"
    register(name, sql, lambda s, d: operator(query(s, d, text)))


one("filter_region", "variants", lambda v: iv.filter_region(v, "chr3", 100, 9000), "SELECT chrom, pos, id, ref, alt, qual FROM variants WHERE chrom = 'chr3' AND pos BETWEEN 100 AND 9000")
one("bin_positions", "variants", lambda v: iv.bin_positions(v, 250), "SELECT CAST(floor(pos / 250) AS BIGINT) AS bin, count(*) AS n FROM variants GROUP BY 1")
one("coverage_histogram", "variants", lambda v: iv.coverage_histogram(v, "chr5", 500), "SELECT CAST(floor(pos / 500) AS BIGINT) AS bin, count(*) AS n FROM variants WHERE chrom = 'chr5' GROUP BY 1")
one("window_coverage", "intervals", lambda v: iv.window_coverage(v, 100), "WITH w AS (SELECT chrom, start, stop, unnest(range(CAST(floor(start / 100) AS BIGINT), CAST(floor((stop - 1) / 100) AS BIGINT) + 1)) AS win FROM intervals WHERE stop > start) SELECT chrom, win AS \"window\", CAST(sum(least(stop, (win + 1) * 100) - greatest(start, win * 100)) AS BIGINT) AS covered FROM w GROUP BY 1, 2")
one(
    "interval_predicates", PAIR,
    lambda p: p.select("a", "b", "c", "d", iv.interval_length(F.col("a"), F.col("b")).alias("len"), iv.interval_contains(F.col("a"), F.col("b"), F.col("c")).alias("has"), iv.interval_overlaps(*map(F.col, "abcd")).alias("meets"), iv.normalize_interval(F.col("d"), F.col("a"))["start"].alias("low")),
    f"SELECT a, b, c, d, greatest(0, b - a) AS len, a <= c AND c < b AS has, greatest(a, c) < least(b, d) AS meets, least(a, d) AS low FROM ({PAIR})",
)
one(
    "interval_set_ops", PAIR,
    lambda p: p.select("a", "b", "c", "d", iv.interval_intersection(*map(F.col, "abcd"))["start"].alias("i0"), iv.interval_intersection(*map(F.col, "abcd"))["stop"].alias("i1"), iv.interval_union(*map(F.col, "abcd"))["start"].alias("u0"), iv.interval_union(*map(F.col, "abcd"))["stop"].alias("u1"), F.size(iv.interval_difference(*map(F.col, "abcd"))).alias("pieces")),
    f"SELECT a, b, c, d, CASE WHEN greatest(a, c) < least(b, d) THEN greatest(a, c) END AS i0, CASE WHEN greatest(a, c) < least(b, d) THEN least(b, d) END AS i1, CASE WHEN greatest(a, c) <= least(b, d) THEN least(a, c) END AS u0, CASE WHEN greatest(a, c) <= least(b, d) THEN greatest(b, d) END AS u1, CASE WHEN greatest(a, c) < least(b, d) THEN CAST(a < c AS INT) + CAST(d < b AS INT) ELSE 1 END AS pieces FROM ({PAIR})",
)
MERGED = "SELECT chrom, {lo}, {hi}, sum(new) OVER (PARTITION BY chrom ORDER BY {lo}, {hi} ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT chrom, {lo}, {hi}, CASE WHEN {lo} <= max({hi}) OVER (PARTITION BY chrom ORDER BY {lo}, {hi} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {slack} THEN 0 ELSE 1 END AS new FROM {source})"


def merged(source, lo="lo", hi="hi", slack=1):
    return f"SELECT chrom, min({lo}) AS {lo}, max({hi}) AS {hi}, count(*) AS merged FROM ({MERGED.format(lo=lo, hi=hi, slack=slack, source=source)}) GROUP BY chrom, k"


one("merge_intervals", "intervals", iv.merge_intervals, f"SELECT chrom, start, stop FROM ({merged('intervals', 'start', 'stop', 0)})")
one("range_reduce", "ranges", iv.reduce, merged("ranges"))
one("range_shift", "ranges", lambda v: iv.shift(v, 25), "SELECT chrom, lo + 25 AS lo, hi + 25 AS hi, strand FROM ranges")
one("range_flank", "ranges", lambda v: iv.flank(v, 30), "SELECT chrom, CASE WHEN strand <> '-' THEN lo - 30 ELSE hi + 1 END AS lo, CASE WHEN strand <> '-' THEN lo - 1 ELSE hi + 30 END AS hi, strand FROM ranges")
one("range_flank_end", "ranges", lambda v: iv.flank(v, 30, start=False), "SELECT chrom, CASE WHEN strand = '-' THEN lo - 30 ELSE hi + 1 END AS lo, CASE WHEN strand = '-' THEN lo - 1 ELSE hi + 30 END AS hi, strand FROM ranges")
one("range_resize_start", "ranges", lambda v: iv.resize(v, 15), "SELECT chrom, lo, lo + 14 AS hi, strand FROM ranges")
one("range_resize_center", "ranges", lambda v: iv.resize(v, 15, "center"), "SELECT chrom, CAST(floor((lo + hi) / 2) AS BIGINT) - 7 AS lo, CAST(floor((lo + hi) / 2) AS BIGINT) + 7 AS hi, strand FROM ranges")
one("range_resize_end", "ranges", lambda v: iv.resize(v, 15, "end"), "SELECT chrom, hi - 14 AS lo, hi, strand FROM ranges")
one("range_promoters", "ranges", lambda v: iv.promoters(v, 200, 50), "SELECT chrom, CASE WHEN strand = '-' THEN hi - 50 ELSE lo - 200 END AS lo, CASE WHEN strand = '-' THEN hi + 199 ELSE lo + 49 END AS hi, strand FROM ranges")
one("range_narrow", "ranges", lambda v: iv.narrow(v, 5, 7), "SELECT chrom, lo + 5 AS lo, hi - 7 AS hi, strand FROM ranges WHERE lo + 5 <= hi - 7")
register("range_trim", f"SELECT r.chrom, greatest(lo, 1) AS lo, least(hi, length) AS hi, strand FROM ranges r JOIN ({LENGTHS}) l ON r.chrom = l.chrom WHERE greatest(lo, 1) <= least(hi, length)", lambda s, d: iv.trim(view(s, d, "ranges"), query(s, d, LENGTHS)))
COVERAGE = "SELECT chrom, pos AS lo, next - 1 AS hi, depth FROM (SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS next, CAST(sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS depth FROM (SELECT chrom, pos, sum(d) AS d FROM (SELECT chrom, lo AS pos, 1 AS d FROM ranges UNION ALL SELECT chrom, hi + 1, -1 FROM ranges) GROUP BY chrom, pos)) WHERE depth > 0"
one("range_coverage", "ranges", iv.coverage, COVERAGE)
register("range_gaps", f"WITH l AS ({LENGTHS}), m AS ({merged('ranges')}), s AS (SELECT chrom, lo, hi FROM m UNION ALL SELECT chrom, length + 1, length + 1 FROM l), g AS (SELECT chrom, coalesce(lag(hi) OVER (PARTITION BY chrom ORDER BY lo, hi), 0) + 1 AS lo, lo - 1 AS hi FROM s) SELECT g.chrom, lo, least(hi, length) AS hi FROM g JOIN l ON g.chrom = l.chrom WHERE lo <= least(hi, length)", lambda s, d: iv.gaps(view(s, d, "ranges"), query(s, d, LENGTHS)))
one("range_disjoin", SOME, iv.disjoin, f"WITH x AS ({SOME}), c AS (SELECT DISTINCT chrom, unnest([lo, hi + 1]) AS lo FROM x), p AS (SELECT chrom, lo, lead(lo) OVER (PARTITION BY chrom ORDER BY lo) - 1 AS hi FROM c) SELECT chrom, lo, hi FROM p WHERE EXISTS (SELECT 1 FROM x WHERE x.chrom = p.chrom AND x.lo <= p.hi AND p.lo <= x.hi)")
PAIRS_SQL = f"SELECT q.chrom, q.lo, q.hi, q.strand, s.lo AS s_lo, s.hi AS s_hi, s.strand AS s_strand FROM ({SOME}) q JOIN ({GENE_RANGES}) s ON q.chrom = s.chrom AND q.lo <= s.hi AND s.lo <= q.hi"


def two(name, operator, sql):
    register(name, sql, lambda s, d: operator(query(s, d, SOME), query(s, d, GENE_RANGES)))


two("find_overlaps", iv.find_overlaps, PAIRS_SQL)
two("overlap_counts", lambda q, s: iv.find_overlaps(q, s).groupBy("chrom", "lo", "hi", "strand").agg(F.count(F.lit(1)).alias("n")), f"SELECT chrom, lo, hi, strand, count(*) AS n FROM ({PAIRS_SQL}) GROUP BY ALL")
two("range_intersect", iv.intersect, f"SELECT chrom, greatest(lo, s_lo) AS lo, least(hi, s_hi) AS hi FROM ({PAIRS_SQL})")
two("range_union", iv.union, f"WITH u AS (SELECT chrom, lo, hi FROM ({SOME}) UNION ALL SELECT chrom, lo, hi FROM ({GENE_RANGES})) {merged('u')}")
two("range_setdiff", iv.setdiff, f"WITH a AS ({SOME}), g AS ({GENE_RANGES}), b AS ({merged('g')}), h AS (SELECT a.chrom, a.lo, a.hi, a.strand, b.lo AS bl, b.hi AS bh FROM a JOIN b ON a.chrom = b.chrom AND a.lo <= b.hi AND b.lo <= a.hi), f AS (SELECT chrom, coalesce(lag(bh) OVER w + 1, lo) AS lo, bl - 1 AS hi, strand FROM h WINDOW w AS (PARTITION BY chrom, lo, hi, strand ORDER BY bl)), t AS (SELECT chrom, max(bh) + 1 AS l, hi, strand FROM h GROUP BY chrom, lo, hi, strand) SELECT chrom, lo, hi, strand FROM f WHERE lo <= hi UNION ALL SELECT chrom, l AS lo, hi, strand FROM t WHERE l <= hi UNION ALL SELECT chrom, lo, hi, strand FROM a ANTI JOIN h USING (chrom, lo, hi, strand)")
two("range_precede", iv.precede, f"WITH q AS ({SOME}), s AS ({GENE_RANGES}) SELECT q.chrom, q.lo, q.hi, q.strand, (x).b AS s_lo, (x).k AS s_hi, (x).s AS s_strand FROM (SELECT q.chrom, q.lo, q.hi, q.strand, max({{'k': s.hi, 'b': s.lo, 's': s.strand}}) AS x FROM q LEFT JOIN s ON q.chrom = s.chrom AND s.hi < q.lo GROUP BY ALL) q")
two("range_follow", iv.follow, f"WITH q AS ({SOME}), s AS ({GENE_RANGES}) SELECT q.chrom, q.lo, q.hi, q.strand, -(x).k AS s_lo, -(x).b AS s_hi, (x).s AS s_strand FROM (SELECT q.chrom, q.lo, q.hi, q.strand, max({{'k': -s.lo, 'b': -s.hi, 's': s.strand}}) AS x FROM q LEFT JOIN s ON q.chrom = s.chrom AND s.lo > q.hi GROUP BY ALL) q")
DISTANCE = f"WITH q AS ({SOME}), s AS ({GENE_RANGES}) SELECT q.chrom, q.lo, q.hi, q.strand, coalesce(min(greatest(0, s.lo - q.hi - 1, q.lo - s.hi - 1)), -1) AS distance FROM q LEFT JOIN s ON q.chrom = s.chrom GROUP BY ALL"
two("range_distance", iv.distance, DISTANCE)
NEAREST = f"WITH q AS ({SOME}), s AS ({GENE_RANGES}), x AS (SELECT q.*, s.lo AS s_lo, s.hi AS s_hi, s.strand AS s_strand, CASE WHEN s.lo <= q.hi AND q.lo <= s.hi THEN 0 WHEN s.hi < q.lo THEN 1 ELSE 2 END AS c FROM q JOIN s ON q.chrom = s.chrom) SELECT chrom, lo, hi, strand, s_lo, s_hi, s_strand FROM x QUALIFY row_number() OVER (PARTITION BY chrom, lo, hi, strand ORDER BY c, CASE c WHEN 0 THEN s_lo WHEN 1 THEN -s_hi ELSE s_lo END, CASE c WHEN 0 THEN s_hi WHEN 1 THEN -s_lo ELSE s_hi END, CASE WHEN c = 0 THEN s_strand END, s_strand DESC) = 1"
two("range_nearest", iv.nearest, NEAREST)
NUMBERED = "SELECT p_partkey AS row, 'chr' || CAST(p_size % 2 AS STRING) AS chrom, p_size * {m} AS lo, p_size * {m} + {w} AS hi FROM part"
register(
    "range_parallel_ops",
    f"WITH a AS ({NUMBERED.format(m=3, w=40)}), b AS ({NUMBERED.format(m=4, w=15)}), p AS (SELECT a.row, a.lo, a.hi, b.lo AS lo2, b.hi AS hi2, greatest(a.lo, b.lo) <= least(a.hi, b.hi) AS meet FROM a JOIN b ON a.row = b.row) SELECT row, CASE WHEN meet THEN greatest(lo, lo2) END AS int_lo, CASE WHEN meet THEN least(hi, hi2) END AS int_hi, least(lo, lo2) AS hull_lo, greatest(hi, hi2) AS hull_hi, CASE WHEN meet THEN CAST(lo < lo2 AS INT) + CAST(hi2 < hi AS INT) ELSE 1 END AS n_diff, CASE WHEN meet THEN greatest(0, lo2 - lo) + greatest(0, hi - hi2) ELSE hi - lo + 1 END AS diff_bases FROM p",
    lambda s, d: iv.parallel_pairs(query(s, d, NUMBERED.format(m=3, w=40)), query(s, d, NUMBERED.format(m=4, w=15))),
)
register("count_features", "SELECT g.name, count(i.start) AS n FROM genes g LEFT JOIN intervals i ON g.chrom = i.chrom AND i.start < g.stop AND g.start < i.stop GROUP BY g.name", lambda s, d: iv.count_features(view(s, d, "intervals"), view(s, d, "genes")))
EFFECTS = "SELECT chrom, start, stop, name, CASE gene_id % 4 WHEN 0 THEN 'intron_variant' WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'synonymous_variant' ELSE 'stop_gained' END AS consequence, CAST(CASE gene_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 5 END AS INT) AS rank FROM genes"
register(
    "annotate_variants", f"SELECT id, name AS feature, rank, n_features FROM (SELECT v.id, g.name, g.rank, count(g.name) OVER (PARTITION BY v.id) AS n_features, row_number() OVER (PARTITION BY v.id ORDER BY g.rank DESC, g.name) AS k FROM variants v LEFT JOIN ({EFFECTS}) g ON v.chrom = g.chrom AND g.start < v.pos AND v.pos <= g.stop) WHERE k = 1",
    lambda s, d: iv.annotate(view(s, d, "variants"), query(s, d, EFFECTS), severity(F.col("consequence"))),
)
DEPTHS = "SELECT chrom, CAST(floor(pos / 50) AS BIGINT) AS b, count(*) % 2 AS v FROM variants GROUP BY 1, 2"
register("signal_run_length", f"WITH x AS ({DEPTHS}), n AS (SELECT *, CASE WHEN lag(b) OVER w = b - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY chrom ORDER BY b)), r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY b) AS k FROM n) SELECT chrom, v, min(b) AS start, max(b) + 1 AS stop FROM r GROUP BY chrom, k, v", lambda s, d: iv.run_length(query(s, d, DEPTHS), ("chrom",), "b", "v"))
