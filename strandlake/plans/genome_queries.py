"""Queries of aligned sequences, populations, motifs, guides, long reads, signals and intensities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.operators import genome as gn
from strandlake.operators import signals as sg
from strandlake.operators.intervals import coverage
from strandlake.plans.views import duck, query

QUERIES, ORACLE_SQL = {}, {}


def one(name, source, operator, sql):
    text = source if " " in source else f"SELECT * FROM {source}"
    QUERIES[name] = lambda s, d: operator(query(s, d, text))
    if sql:
        ORACLE_SQL[name] = duck(sql.replace("@", f"({text})"))


def r(column, digits=7):
    return F.round(column, digits).alias(column)


ALIGNED = "SELECT doc_id, seq FROM pieces"
SITES = f"SELECT pos, sym, count(*) AS n FROM (SELECT i AS pos, substr(seq, i, 1) AS sym FROM (SELECT seq, unnest(range(1, 61)) AS i FROM ({ALIGNED}))) GROUP BY 1, 2"
SUMMARY = f"SELECT pos, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS total, min(n) AS rarest, (pow(sum(n), 2) - sum(n * n)) / (sum(n) * (sum(n) - 1)) AS differing FROM ({SITES}) GROUP BY pos"
one("segregating_sites", ALIGNED, lambda d: gn.site_summary(d).select("pos", "kinds", "total", "rarest", r("differing")), f"SELECT pos, kinds, total, rarest, round(differing, 7) AS differing FROM ({SUMMARY})")
one("diversity_statistics", ALIGNED, lambda d: gn.diversity_statistics(d).select("n", "segregating", r("pi"), r("theta"), r("tajima_d", 5)), f"WITH s AS (SELECT count_if(kinds > 1) AS s, sum(differing) AS k FROM ({SUMMARY})), x AS (SELECT count(*)::DOUBLE AS n FROM @), h AS (SELECT sum(1 / i) AS a1, sum(1 / (i * i)) AS a2 FROM (SELECT unnest(range(1, CAST(n AS BIGINT)))::DOUBLE AS i FROM x)), c AS (SELECT *, (n + 1) / (3 * (n - 1)) - 1 / a1 AS c1, 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1) AS c2 FROM s, x, h) SELECT CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS segregating, round(k / 60, 7) AS pi, round(s / a1 / 60, 7) AS theta, round((k - s / a1) / sqrt(c1 / a1 * s + c2 / (a1 * a1 + a2) * s * (s - 1)), 5) AS tajima_d FROM c")
TWO = "SELECT doc_id, translate(seq, 'GC', 'AT') AS seq FROM pieces"
one("site_frequency_spectrum", TWO, lambda d: gn.site_spectrum(d), "WITH c AS (SELECT i, substr(seq, i, 1) AS s, count(*) AS n FROM (SELECT seq, unnest(range(1, 61)) AS i FROM @) GROUP BY 1, 2), m AS (SELECT i, min(n) AS minor FROM c GROUP BY i HAVING count(*) = 2) SELECT minor, count(*) AS sites FROM m GROUP BY 1")
one("alignment_consensus", ALIGNED, lambda d: gn.consensus(d, least=0.35), f"SELECT pos, CASE WHEN n / t >= 0.35 THEN sym ELSE 'N' END AS letter FROM (SELECT *, sum(n) OVER (PARTITION BY pos) AS t FROM ({SITES})) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, sym) = 1")
P = "SELECT pop, snp, avg(dosage) / 2 AS p FROM genotypes WHERE dosage IS NOT NULL GROUP BY 1, 2"
FOUR = f"SELECT snp, max(p) FILTER (pop = 1) AS a, max(p) FILTER (pop = 2) AS b, max(p) FILTER (pop = 3) AS c, max(p) FILTER (pop = 4) AS d FROM ({P}) GROUP BY snp"
one("tree_f_statistics", "genotypes", lambda d: gn.f_statistics_of_trees(gn.frequencies(d), [1, 2, 3, 4]).select(r("f3"), r("f4"), r("d"), "n"), f"SELECT round(avg((c - a) * (c - b)), 7) AS f3, round(avg((a - b) * (c - d)), 7) AS f4, round(sum((1 - a) * b * c * (1 - d) - a * (1 - b) * c * (1 - d)) / sum((1 - a) * b * c * (1 - d) + a * (1 - b) * c * (1 - d)), 7) AS d, count(*) AS n FROM ({FOUR}) WHERE a + b + c + d IS NOT NULL")
one("nei_distance", "genotypes", lambda d: gn.nei_distance(gn.frequencies(d)).select("a", "b", r("distance")), f"WITH p AS ({P}) SELECT x.pop AS a, y.pop AS b, round(-ln(sum(x.p * y.p + (1 - x.p) * (1 - y.p)) / sqrt(sum(x.p * x.p + (1 - x.p) * (1 - x.p)) * sum(y.p * y.p + (1 - y.p) * (1 - y.p)))), 7) + 0 AS distance FROM p x JOIN p y ON x.snp = y.snp AND x.pop < y.pop GROUP BY 1, 2")
one("differentiation", "genotypes", lambda d: gn.differentiation(gn.frequencies(d)).select("snp", r("gst"), r("jost_d")), f"WITH s AS (SELECT snp, 2 * avg(p) * (1 - avg(p)) AS ht, avg(2 * p * (1 - p)) AS hs, count(*) AS k FROM ({P}) GROUP BY snp) SELECT snp, round(CASE WHEN ht > 0 THEN (ht - hs) / ht ELSE 0 END, 7) AS gst, round((ht - hs) / (1 - hs) * k / (k - 1), 7) AS jost_d FROM s WHERE k > 1")
MATRIX = f"SELECT pos, " + ", ".join(f"(coalesce(sum(n) FILTER (sym = '{b}'), 0) + 0.5::DOUBLE) / (sum(n) + 2) AS \"{b}\"" for b in "ACGT") + f" FROM ({SITES}) GROUP BY pos"
one("motif_matrix", ALIGNED, lambda d: gn.frequency_matrix(gn.site_counts(d), 0.5).select("pos", *[r(b) for b in "ACGT"]), "SELECT pos, " + ", ".join(f'round("{b}", 7) AS "{b}"' for b in "ACGT") + f" FROM ({MATRIX})")
ENT = " + ".join(f'-("{b}" * log2("{b}"))' for b in "ACGT")
one("motif_information", ALIGNED, lambda d: gn.matrix_entropy(gn.frequency_matrix(gn.site_counts(d), 0.5)).select("pos", r("entropy"), r("information")), f"SELECT pos, round({ENT}, 7) AS entropy, round(2 - ({ENT}), 7) AS information FROM ({MATRIX})")
WEIGHTS = [{"A": 1.0, "C": -1.0, "G": -0.5, "T": 0.5}, {"A": -1.0, "C": 1.0, "G": 0.5, "T": -0.5}, {"A": 0.25, "C": -1.0, "G": 1.0, "T": 0.5}, {"A": -0.5, "C": -1.0, "G": -1.0, "T": 1.0}]
KMERS = "SELECT doc_id, i AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, len(seq) - {k} + 2)) AS i FROM dna)"


def case(s):
    return " + ".join("CASE substr(%s, %d, 1) %s END" % (s, i + 1, " ".join(f"WHEN '{x}' THEN {w}::DOUBLE" for x, w in col.items())) for i, col in enumerate(WEIGHTS))


one("motif_scan", "dna", lambda d: gn.scan(d, "seq", WEIGHTS, 2.5), f"SELECT doc_id, pos, strand, score FROM (SELECT doc_id, pos, '+' AS strand, {case('kmer')} AS score FROM ({KMERS.format(k=4)}) UNION ALL SELECT doc_id, pos, '-', {case('rc')} FROM (SELECT *, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM ({KMERS.format(k=4)}))) WHERE score >= 2.5")
GUIDE = "ATTATTAATA"
one("off_targets", "dna", lambda d: gn.off_targets(d, "seq", GUIDE, 5), f"SELECT doc_id, pos, strand, substr(x, 1, 10) AS site, CAST(hamming(substr(x, 1, 10), '{GUIDE}') AS INT) AS mismatches FROM (SELECT doc_id, pos, '+' AS strand, kmer AS x FROM ({KMERS.format(k=13)}) UNION ALL SELECT doc_id, pos, '-', reverse(translate(kmer, 'ACGT', 'TGCA')) FROM ({KMERS.format(k=13)})) WHERE substr(x, 12, 2) = 'GG' AND hamming(substr(x, 1, 10), '{GUIDE}') <= 5")
SCREEN = "SELECT p_partkey AS guide, p_brand AS gene, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS t, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_brand"
one("crispr_screen", SCREEN, lambda d: gn.screen_fold_change(d, "guide", "gene", "t", "c").select("gene", "n_guides", r("mean_lfc", 6), r("median_lfc", 6)), "WITH x AS (SELECT gene, log2(((t + 1) / sum(t) OVER ()) / ((c + 1) / sum(c) OVER ())) AS f FROM @) SELECT gene, count(*) AS n_guides, round(avg(f), 6) AS mean_lfc, round(median(f), 6) AS median_lfc FROM x GROUP BY gene")
CIGARS = "SELECT event_id, event_id * 10 AS pos, CAST(user_id % 50 + 1 AS STRING) || 'M' || CAST(event_id % 70 + 1 AS STRING) || 'D' || CAST(user_id % 20 + 5 AS STRING) || 'M' || CAST(event_id % 45 + 1 AS STRING) || 'I10M' AS cigar, event_id % 70 + 1 AS d, event_id % 45 + 1 AS i, user_id % 50 + 1 AS a, user_id % 20 + 5 AS b FROM events"
one("split_read_events", CIGARS, lambda d: gn.cigar_events(d, "event_id", "pos", "cigar").withColumn("size", F.col("size").cast("long")), "SELECT event_id, 'DEL' AS kind, pos + a AS start, d AS size FROM @ WHERE d >= 30 UNION ALL SELECT event_id, 'INS', pos + a + d + b, i FROM @ WHERE i >= 30")
EVIDENCE = "SELECT chrom, pos, user_id AS read FROM variants"
one("cluster_variants", EVIDENCE, lambda d: gn.cluster_events(d, ["chrom"], "pos", "read", 40, 3), "WITH x AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, read) <= 40 THEN 0 ELSE 1 END AS new FROM @), y AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos, read ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT chrom, count(DISTINCT read) AS support, min(pos) AS first, max(pos) AS last FROM y GROUP BY chrom, k HAVING count(DISTINCT read) >= 3")


def regions(d):
    index = sq.kmers(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), "seq"), "seq", 16).withColumnRenamed("kmer", "hash")
    reads = sq.kmers(d.select("doc_id", "seq"), "seq", 16).withColumnRenamed("kmer", "hash")
    return gn.candidate_regions(reads, index, "doc_id", 5).where("support >= 3")


one("candidate_regions", "dna", regions, f"WITH i AS (SELECT 'd' || doc_id AS chrom, pos, kmer FROM ({KMERS.format(k=16)}) QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY 'd' || doc_id, pos) <= 5) SELECT q.doc_id, chrom, i.pos - q.pos AS start, count(*) AS support FROM ({KMERS.format(k=16)}) q JOIN i USING (kmer) GROUP BY ALL HAVING count(*) >= 3")
FRAGMENTS = "SELECT DISTINCT 'f' || chrom || '-' || CAST(lo AS STRING) || '-' || CAST(hi AS STRING) || strand AS id, chrom, lo, hi FROM ranges"
PEAKS = "SELECT DISTINCT chrom, start + 1 AS lo, stop AS hi, gene_id AS peak FROM genes"
QUERIES["best_peak"] = lambda s, d: sg.best_peak(query(s, d, FRAGMENTS), query(s, d, PEAKS), "id")
ORACLE_SQL["best_peak"] = duck(f"SELECT f.id, p.peak, least(f.hi, p.hi) - greatest(f.lo, p.lo) + 1 AS bases FROM ({FRAGMENTS}) f JOIN ({PEAKS}) p ON f.chrom = p.chrom AND f.lo <= p.hi AND p.lo <= f.hi QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY least(f.hi, p.hi) - greatest(f.lo, p.lo) DESC, p.lo, p.peak) = 1")
SAMPLED = "SELECT chrom, lo, hi, lo % 4 AS sample FROM ranges"
QUERIES["peak_support"] = lambda s, d: sg.peak_support(query(s, d, SAMPLED), query(s, d, PEAKS), "sample")
ORACLE_SQL["peak_support"] = duck(f"SELECT p.peak, f.sample, count(*) AS n FROM ({SAMPLED}) f JOIN ({PEAKS}) p ON f.chrom = p.chrom AND f.lo <= p.hi AND p.lo <= f.hi GROUP BY 1, 2")
QUERIES["call_peaks"] = lambda s, d: sg.simple_peaks(coverage(query(s, d, "SELECT * FROM ranges")), 3, 5).select("chrom", "lo", "hi", "summit")
CALLS = "SELECT chrom, pos, event_type AS sample, user_id % 7 AS methylated, user_id % 7 + event_id % 4 AS total FROM variants"
one("bin_methylation", CALLS, lambda d: sg.bin_methylation(d, 500, ["sample"]).withColumn("level", r("level")), "SELECT chrom, CAST(floor(pos / 500) * 500 AS BIGINT) AS bin, sample, CAST(sum(methylated) AS BIGINT) AS methylated, CAST(sum(total) AS BIGINT) AS total, round(CASE WHEN sum(total) > 0 THEN sum(methylated) / sum(total) END, 7) AS level FROM @ GROUP BY ALL")
CELLS = "SELECT l_orderkey AS cell, p_brand AS peak, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
one("tf_idf", CELLS, lambda d: sg.tf_idf(d, "peak", "cell", "n").select("cell", "peak", r("tfidf")), "SELECT cell, peak, round(n / sum(n) OVER (PARTITION BY cell) * ln(1 + (SELECT count(DISTINCT cell) FROM @) / count(*) OVER (PARTITION BY peak)), 7) AS tfidf FROM @")
FEATURES = "SELECT gene AS feature, sample, count AS value FROM counts"
one("co_accessibility", FEATURES, lambda d: sg.co_accessibility(d, 0.3).select("a", "b", "n", r("r")), "SELECT x.feature AS a, y.feature AS b, count(*) AS n, round(corr(x.value, y.value), 7) AS r FROM @ x JOIN @ y ON x.sample = y.sample AND x.feature < y.feature GROUP BY 1, 2 HAVING abs(corr(x.value, y.value)) >= 0.3")
CONTACTS = "SELECT l_partkey AS x, l_suppkey * 20 AS y FROM lineitem"
MAP = "WITH c AS (SELECT least(i, j) AS i, greatest(i, j) AS j, count(*) AS n FROM (SELECT CAST(floor(x / 50) AS BIGINT) AS i, CAST(floor(y / 50) AS BIGINT) AS j FROM @) GROUP BY 1, 2), m AS (SELECT * FROM c UNION ALL SELECT j, i, n FROM c WHERE i <> j)"
one("contact_matrix", CONTACTS, lambda d: sg.contact_matrix(d, 50), MAP + " SELECT * FROM m")
one("insulation_score", CONTACTS, lambda d: sg.insulation(sg.contact_matrix(d, 50), 5, 41).select("bin", r("score")), MAP + ", b AS (SELECT unnest(range(0, 40)) AS bin) SELECT bin, round(log2(1 + sum(n) / (least(bin + 1, 5) * least(40 - bin, 5))), 7) AS score FROM b JOIN m ON m.i BETWEEN bin - 4 AND bin AND m.j BETWEEN bin + 1 AND bin + 5 GROUP BY bin")
one("contact_boundaries", CONTACTS, lambda d: sg.boundaries(sg.insulation(sg.contact_matrix(d, 50), 5, 41).withColumn("score", r("score")), [], "bin", "score"), MAP + ", b AS (SELECT unnest(range(0, 40)) AS bin), s AS (SELECT bin, round(log2(1 + sum(n) / (least(bin + 1, 5) * least(40 - bin, 5))), 7) AS score FROM b JOIN m ON m.i BETWEEN bin - 4 AND bin AND m.j BETWEEN bin + 1 AND bin + 5 GROUP BY bin) SELECT bin, score FROM s QUALIFY score <= lag(score) OVER (ORDER BY bin) AND score <= lead(score) OVER (ORDER BY bin)")
NORMAL = {
    "total": "value / sum(value) OVER (PARTITION BY sample)", "median": "value / median(value) OVER (PARTITION BY sample)", "log": "log2(value + 1)",
    "zscore": "(value - avg(value) OVER (PARTITION BY feature)) / stddev_samp(value) OVER (PARTITION BY feature)",
}
for how, text in NORMAL.items():
    one(f"normalize_{how}", FEATURES, lambda d, how=how: sg.normalize(d, how).select("feature", "sample", r("normalized")), f"SELECT feature, sample, round({text}, 7) + 0 AS normalized FROM @")
one("normalize_pqn", FEATURES, lambda d: sg.normalize(d, "pqn").select("feature", "sample", r("normalized", 6)), "WITH r AS (SELECT feature, median(value) AS r FROM @ GROUP BY 1), q AS (SELECT sample, median(value / r) AS q FROM @ JOIN r USING (feature) WHERE r > 0 GROUP BY 1) SELECT feature, sample, round(value / q, 6) AS normalized FROM @ JOIN q USING (sample)")
GAPPY = "SELECT p_brand AS feature, l_suppkey AS sample, CASE WHEN l_partkey % 5 = 0 THEN 0.0 ELSE l_extendedprice END AS value, CASE WHEN l_suppkey % 4 = 0 THEN 'QC' ELSE 'S' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey"
one("missing_values", GAPPY, lambda d: sg.missing(d, "feature", "value").withColumn("fraction", r("fraction")), "SELECT feature, count(*) AS n, CAST(count_if(value = 0) AS BIGINT) AS n_missing, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END), 7) AS fraction FROM @ GROUP BY feature")
one("intensity_quality", GAPPY, lambda d: sg.quality_control(d, "kind", cv=0.8, lost=0.22).select("feature", r("cv", 6), r("missing"), "passed"), "WITH x AS (SELECT feature, stddev_samp(value) FILTER (kind = 'QC') / avg(value) FILTER (kind = 'QC') AS cv, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS m FROM @ GROUP BY feature) SELECT feature, round(cv, 6) AS cv, round(m, 7) AS missing, cv <= 0.8 AND m <= 0.22 AS passed FROM x")
one("center_batches", "SELECT gene AS feature, sample, count AS value, length(sample) AS batch FROM counts", lambda d: sg.center_batches(d, "batch", "median").select("feature", "sample", r("corrected")), "SELECT feature, sample, round(value - median(value) OVER (PARTITION BY feature, batch) + median(value) OVER (PARTITION BY feature), 7) AS corrected FROM @")
one("volcano_classes", "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 10 - 2.5 AS fold, CAST(p_partkey % 100 AS DOUBLE) / 1000 AS padj FROM part", lambda d: sg.volcano(d, "fold", "padj").select("id", "kind"), "SELECT id, CASE WHEN padj <= 0.05 AND fold >= 1 THEN 'up' WHEN padj <= 0.05 AND fold <= -1 THEN 'down' ELSE 'neutral' END AS kind FROM @")
one("peak_table", "SELECT CAST(user_id AS DOUBLE) / 8 AS axis, value FROM events", lambda d: sg.peak_table(d, 0.5, 100).withColumn("intensity", r("intensity", 4)), "SELECT CAST(floor((axis - (SELECT min(axis) FROM @)) / 0.5) AS BIGINT) AS bin, round(sum(value), 4) AS intensity FROM @ GROUP BY 1 HAVING sum(value) >= 100")
