"""Queries of clonotype, somatic and clinical tables over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import stats
from strandlake.operators import repertoire as rp
from strandlake.plans.views import duck, query

QUERIES, ORACLE_SQL = {}, {}


def one(name, source, operator, sql):
    text = source if " " in source else f"SELECT * FROM {source}"
    QUERIES[name] = lambda s, d: operator(query(s, d, text))
    ORACLE_SQL[name] = duck(sql.replace("@", f"({text})"))


def r(column, digits=9):
    return F.round(column, digits).alias(column)


one("clonotype_table", "clonotypes", lambda d: rp.clonotype_table(d).withColumn("frequency", r("frequency")), "SELECT CAST(clone AS VARCHAR) AS clone, count(*) AS n_cells, round(count(*) / sum(count(*)) OVER (), 9) AS frequency FROM clonotypes GROUP BY clone")
one("clonotype_by_sample", "clonotypes", lambda d: rp.clonotype_table(d, by=("sample",)).withColumn("frequency", r("frequency")), "SELECT sample, CAST(clone AS VARCHAR) AS clone, count(*) AS n_cells, round(count(*) / sum(count(*)) OVER (PARTITION BY sample), 9) AS frequency FROM clonotypes GROUP BY sample, clone")
one("isotype_switching", "clonotypes", lambda d: rp.switching_summary(d, "clone", "sample"), "WITH n AS (SELECT clone, sample, count(*) AS n FROM clonotypes GROUP BY 1, 2) SELECT clone, CAST(sum(n) AS BIGINT) AS n_cells, count(*) AS n_kinds, count(*) - 1 AS switches, arg_min(sample, {'n': -n, 's': sample}) AS dominant FROM n GROUP BY clone")
one("germline_usage_bias", "clonotypes", lambda d: rp.usage_bias(d, "clone").select("clone", "n", r("frequency"), r("chi_square", 4), "df"), "WITH n AS (SELECT clone, count(*) AS n FROM clonotypes GROUP BY 1) SELECT clone, n, round(n / sum(n) OVER (), 9) AS frequency, round((SELECT sum(pow(n - e, 2) / e) FROM n, (SELECT sum(n) / count(*) AS e FROM n)), 4) AS chi_square, count(*) OVER () - 1 AS df FROM n")
DIVERSITY = "SELECT {by}, CAST(sum(n) AS BIGINT) AS total, count(*) AS richness, round(-sum(p * ln(p)), 6) + 0 AS shannon, round(sum(p * p), 9) AS simpson, round(1 / sum(p * p), 5) AS inverse_simpson FROM (SELECT *, n / sum(n) OVER (PARTITION BY {by}) AS p FROM ({n}) WHERE n > 0) GROUP BY {by}"
one("repertoire_diversity", "clonotypes", lambda d: rp.diversity(d, "clone", ["sample"]).select("sample", "total", "richness", r("shannon", 6), r("simpson"), r("inverse_simpson", 5)), DIVERSITY.format(by="sample", n="SELECT sample, clone, count(*) AS n FROM clonotypes GROUP BY 1, 2"))
one("clonal_expansion", "clonotypes", lambda d: rp.two_by_two(d, "clone", F.col("sample") == "purchase").select("clone", "case_count", "control_count", r("odds_ratio", 8)), "WITH n AS (SELECT clone, CAST(count_if(sample = 'purchase') AS BIGINT) AS a, CAST(count_if(sample <> 'purchase') AS BIGINT) AS c FROM clonotypes GROUP BY 1) SELECT clone, a AS case_count, c AS control_count, round(((a + 0.5) * (sum(c) OVER () - c + 0.5))::DOUBLE / ((sum(a) OVER () - a + 0.5) * (c + 0.5))::DOUBLE, 8) AS odds_ratio FROM n")
one("clonotype_trajectory", "clonotypes", lambda d: rp.trajectory(d, "clone", "timepoint", [0, 1, 2, 3, 4]).select("clone", *[r(f"freq_{t}") for t in range(5)], r("delta"), "expansion_class"), "WITH n AS (SELECT timepoint, clone, count(*) / sum(count(*)) OVER (PARTITION BY timepoint) AS f FROM clonotypes GROUP BY 1, 2), w AS (SELECT clone, " + ", ".join(f"coalesce(max(f) FILTER (timepoint = {t}), 0) AS freq_{t}" for t in range(5)) + " FROM n GROUP BY clone) SELECT clone, " + ", ".join(f"round(freq_{t}, 9) AS freq_{t}" for t in range(5)) + ", round(freq_4 - freq_0, 9) AS delta, CASE WHEN freq_4 - freq_0 > 0.01 THEN 'expanding' WHEN freq_4 - freq_0 < -0.01 THEN 'contracting' ELSE 'stable' END AS expansion_class FROM w WHERE greatest(freq_0, freq_1, freq_2, freq_3, freq_4) >= 0.001")
one("clone_sample_pivot", "clonotypes", lambda d: d.groupBy("clone").pivot("timepoint", [0, 1, 2, 3]).agg(F.count(F.lit(1))).na.fill(0).toDF("clone", "t0", "t1", "t2", "t3"), "SELECT clone, " + ", ".join(f"CAST(count_if(timepoint = {t}) AS BIGINT) AS t{t}" for t in range(4)) + " FROM clonotypes GROUP BY clone")
PEPTIDES = "SELECT DISTINCT upper(replace(p_brand || p_type, ' ', '')) AS s FROM part"
one("cdr3_distance", PEPTIDES, lambda d: rp.pairs_within(d, "s", 6), "SELECT a, b, d FROM (SELECT a.s AS a, b.s AS b, hamming(substr(a.s, 1, least(len(a.s), len(b.s))), substr(b.s, 1, least(len(a.s), len(b.s)))) + 1.5::DOUBLE * abs(len(a.s) - len(b.s)) AS d FROM @ a JOIN @ b ON a.s < b.s) WHERE d <= 6")
CDR = "SELECT doc_id, 'C' || substring(seq, 1, 30) || 'TF' AS s FROM dna"
one("cdr3_length_spectrum", CDR, lambda d: d.select(F.length(rp.extract_cdr3(F.col("s"))).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("n")), f"SELECT len(nullif(regexp_extract(s, '{rp.CDR3}'), '')) AS len, count(*) AS n FROM @ GROUP BY 1")
BURDEN = "SELECT user_id AS sample, CASE event_id % 5 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'stop_gained' WHEN 2 THEN 'synonymous_variant' WHEN 3 THEN 'frameshift_variant' ELSE 'intron_variant' END AS consequence, chrom AS gene, pos % 50 AS position, ref, alt, id, qual FROM variants"
one("tumor_mutational_burden", BURDEN, lambda d: rp.mutational_burden(d, "sample", "consequence").withColumn("tmb", r("tmb")), "SELECT sample, count(*) AS n_variants, CAST(count_if(consequence IN ('missense_variant', 'frameshift_variant', 'stop_gained', 'start_lost', 'splice_region_variant')) AS BIGINT) AS n_nonsyn, round(count_if(consequence IN ('missense_variant', 'frameshift_variant', 'stop_gained', 'start_lost', 'splice_region_variant')) / 30.0::DOUBLE, 9) AS tmb FROM @ GROUP BY sample")
one("somatic_hotspots", BURDEN, lambda d: rp.hotspots(d, "gene", "position", "sample", 5), "SELECT gene, position, count(DISTINCT sample) AS n_samples, count(*) AS n FROM @ GROUP BY ALL HAVING count(DISTINCT sample) >= 5")
one("mutational_spectrum", BURDEN, lambda d: rp.spectrum(d, F.concat(F.substring(F.lit("ACGT"), (F.col("position") % 4 + 1).cast("int"), F.lit(1)), F.col("ref"), F.substring(F.lit("TGCA"), (F.col("position") % 3 + 1).cast("int"), F.lit(1))), "ref", "alt", "gene").withColumn("fraction", r("fraction")), "SELECT gene, substr('ACGT', position % 4 + 1, 1) || '[' || ref || '>' || alt || ']' || substr('TGCA', position % 3 + 1, 1) AS kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY gene), 9) AS fraction FROM @ GROUP BY 1, 2")
one("variant_filter", BURDEN, lambda d: rp.variant_filter(d, 30).select("id", "qual"), "SELECT id, qual FROM @ WHERE qual >= 30")
CALLS = "SELECT 'chr' || CAST(user_id % 5 AS STRING) AS chrom1, event_id % 40 AS pos1, 'chr' || CAST(event_id % 3 AS STRING) AS chrom2, user_id % 7 AS pos2 FROM events"
one("sv_breakpoint_graph", CALLS, rp.breakpoint_graph, "SELECT chrom1 || ':' || pos1 AS a, chrom2 || ':' || pos2 AS b, count(*) AS support FROM @ GROUP BY 1, 2")
READS = "SELECT DISTINCT CAST(event_id % 23 AS BIGINT) AS ref_n, CAST(user_id % 19 AS BIGINT) AS alt_n FROM events"
one("germline_call", READS, lambda d: d.select("ref_n", "alt_n", rp.genotype_call(F.col("ref_n"), F.col("alt_n")).alias("gt")), "WITH l AS (SELECT *, ln((1 - 0.001::DOUBLE) / 2) + alt_n * ln(0.001::DOUBLE) + ref_n * ln(0.999::DOUBLE) AS a, ln(0.001::DOUBLE) + (alt_n + ref_n) * ln(0.5::DOUBLE) AS h, ln((1 - 0.001::DOUBLE) / 2) + alt_n * ln(0.999::DOUBLE) + ref_n * ln(0.001::DOUBLE) AS b FROM @) SELECT ref_n, alt_n, CASE WHEN ref_n + alt_n = 0 THEN './.' WHEN a >= h AND a >= b THEN '0/0' WHEN h >= b THEN '0/1' ELSE '1/1' END AS gt FROM l")
RISK = "WITH s AS (SELECT {by} time, CAST(sum(status) AS BIGINT) AS events, count(*) AS leaving FROM survival {where} GROUP BY {by} time), k AS (SELECT *, CAST(sum(leaving) OVER ({part} ORDER BY time DESC) AS BIGINT) AS at_risk FROM s)"
KM = " SELECT {by} time, at_risk, events, leaving - events AS censored, round(CASE WHEN min(at_risk - events) OVER w = 0 THEN 0.0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END, 8) AS survival FROM k WHERE events > 0 WINDOW w AS ({part} ORDER BY time)"
one("kaplan_meier", "survival", lambda d: rp.kaplan_meier(d).withColumn("survival", r("survival", 8)), RISK.format(by="", where="", part="") + KM.format(by="", part=""))
one("kaplan_meier_by_group", "survival", lambda d: rp.kaplan_meier(d, by=("grp",)).withColumn("survival", r("survival", 8)), RISK.format(by="grp,", where="", part="PARTITION BY grp") + KM.format(by="grp,", part="PARTITION BY grp"))
one("logrank_test", "survival", lambda d: rp.logrank(d, "time", "status", "grp", "BUILDING", "MACHINERY").select("observed", *[r(c, 5) for c in ("expected", "variance", "chi_square")]), "WITH x AS (SELECT * FROM survival WHERE grp IN ('BUILDING', 'MACHINERY')), t AS (SELECT DISTINCT time FROM x WHERE status = 1), k AS (SELECT t.time, count(*) AS n, count_if(grp = 'BUILDING') AS n1, count_if(x.time = t.time AND status = 1) AS d, count_if(x.time = t.time AND status = 1 AND grp = 'BUILDING') AS d1 FROM t JOIN x ON x.time >= t.time GROUP BY t.time), s AS (SELECT CAST(sum(d1) AS BIGINT) AS observed, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM k) SELECT observed, round(expected, 5) AS expected, round(variance, 5) AS variance, round(pow(observed - expected, 2) / variance, 5) AS chi_square FROM s")
COMPETING = "SELECT time, CASE WHEN status = 1 THEN 1 WHEN id % 3 = 0 THEN 2 ELSE 0 END AS cause FROM survival"
one("cumulative_incidence", COMPETING, lambda d: rp.cumulative_incidence(d, "time", "cause").withColumn("cif", r("cif", 8)), "WITH s AS (SELECT time, count_if(cause > 0) AS e, count(*) AS l FROM @ GROUP BY time), k AS (SELECT *, sum(l) OVER (ORDER BY time DESC) AS n FROM s), b AS (SELECT *, exp(coalesce(sum(CASE WHEN e < n THEN ln(1 - e / n) ELSE -700 END) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM k), c AS (SELECT cause, time, count(*) AS d FROM @ WHERE cause > 0 GROUP BY ALL) SELECT cause, time, d, round(sum(before * d / n) OVER (PARTITION BY cause ORDER BY time), 8) AS cif FROM c JOIN b USING (time)")
MAF = "SELECT event_type AS sample, 'G' || CAST(user_id % 30 AS STRING) AS gene, CASE WHEN event_id % 3 = 0 THEN 'SNP' ELSE 'DEL' END AS class FROM events"
one("summarize_maf", MAF, lambda d: rp.summarize_mutations(d, "sample", "gene", "class"), "SELECT 'sample' AS level, sample AS value, count(*) AS n FROM @ GROUP BY sample UNION ALL SELECT 'gene', gene, count(*) FROM @ GROUP BY gene UNION ALL SELECT 'class', class, count(*) FROM @ GROUP BY class")
one("oncoprint", MAF, lambda d: d.groupBy("gene", "sample").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("class")), ";").alias("labels")), "SELECT gene, sample, count(*) AS n, string_agg(DISTINCT class, ';' ORDER BY class) AS labels FROM @ GROUP BY gene, sample")
QUERIES["omop_visit_summary"] = lambda s, d: rp.visit_summary(query(s, d, "SELECT c_custkey AS person_id, c_nationkey AS place FROM customer"), query(s, d, "SELECT o_custkey AS person_id, o_orderstatus AS kind FROM orders"), "person_id", F.col("kind") == "O", F.col("kind") == "F")
ORACLE_SQL["omop_visit_summary"] = "SELECT c_custkey AS person_id, c_nationkey AS place, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS n_visits, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS n_conditions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"
one("trial_suitability", "SELECT c_custkey AS id, 20 + c_custkey % 70 AS age, c_nationkey % 4 AS ecog, c_custkey % 2 AS m FROM customer", lambda d: d.select("id", F.round(rp.suitability(F.col("age"), F.col("ecog"), [F.col("m")]), 9).alias("score")), "SELECT id, round((least(greatest((75 - age) / 40.0::DOUBLE, 0), 1) + least(greatest((2 - ecog) / 2.0::DOUBLE, 0), 1) + m) / 3, 9) AS score FROM @")
PVALUES = "SELECT p_partkey AS id, CAST(p_partkey % 997 + 1 AS DOUBLE) / CAST(2004 AS DOUBLE) AS p FROM part"
one("benjamini_hochberg", PVALUES, lambda d: stats.adjust_bh(d, "p", "id").select("id", r("padj", 8)), "WITH k AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM @) SELECT id, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 8) AS padj FROM k")
one("average_ranks", "counts", lambda d: d.select("gene", "sample", stats.average_rank("count", ["sample"]).alias("rank")), "SELECT gene, sample, rank() OVER (PARTITION BY sample ORDER BY count) + (count(*) OVER (PARTITION BY sample, count) - 1) / 2 AS rank FROM counts")
