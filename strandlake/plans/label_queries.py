"""Queries of labels and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import labels as lb
from strandlake.plans.views import duck, query

QUERIES, ORACLE_SQL = {}, {}


def one(name, source, operator, sql):
    QUERIES[name] = lambda s, d: operator(query(s, d, source))
    ORACLE_SQL[name] = duck(sql.replace("@", f"({source})"))


def r(column, digits=7):
    return F.round(column, digits).alias(column)


def case(column, table, other):
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in table.items()) + f" ELSE {quote(other)} END"


KINDS = ["stop_gained", "missense_variant", "splice_region_variant", "synonymous_variant", "intron_variant", "inframe_deletion", "other"]
VARIANTS = "SELECT event_id, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END AS c FROM events"
one("consequence_impact", VARIANTS, lambda d: d.select("event_id", lb.severity(F.col("c")).alias("score"), lb.impact(F.col("c")).alias("impact")), f"SELECT event_id, {case('c', lb.SEVERITY, 0)} AS score, CASE WHEN {case('c', lb.SEVERITY, 0)} >= 5 THEN 'HIGH' WHEN {case('c', lb.SEVERITY, 0)} >= 3 THEN 'MODERATE' ELSE 'LOW' END AS impact FROM @")
one("variant_tiers", VARIANTS, lambda d: d.select("event_id", lb.tier(F.col("c")).alias("tier"), lb.tier_label(F.col("c")).alias("label")), f"SELECT event_id, {case('c', lb.TIERS, 3)} AS tier, ['Tier_I', 'Tier_II', 'Tier_III', 'Tier_IV'][{case('c', lb.TIERS, 3)}] AS label FROM @")
CALLS = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'CYP2D6' WHEN 1 THEN 'CYP2C19' ELSE 'X' END AS gene, CASE event_id % 4 WHEN 0 THEN 'rs16947' WHEN 1 THEN 'rs4244285' WHEN 2 THEN 'rs3892097' ELSE 'rs1' END AS variant FROM events"
one("star_alleles", CALLS, lambda d: d.select("event_id", lb.star_allele(F.col("gene"), F.col("variant")).alias("allele")), f"SELECT event_id, {case(chr(40) + 'gene || ' + chr(39) + ':' + chr(39) + ' || variant' + chr(41), lb.STAR_ALLELES, 'unknown')} AS allele FROM @")
DIPLOTYPES = "SELECT DISTINCT a || s || b AS diplotype, a, b FROM (SELECT CASE event_id % 5 WHEN 0 THEN '*1' WHEN 1 THEN '*4' WHEN 2 THEN '*10' WHEN 3 THEN '*41' ELSE '*99' END AS a, CASE user_id % 4 WHEN 0 THEN '*1' WHEN 1 THEN '*5' WHEN 2 THEN '*17' ELSE '*2' END AS b, CASE event_id % 2 WHEN 0 THEN '/' ELSE '+' END AS s FROM events)"
SUM = f"({case('a', lb.ACTIVITY, 0.5)} + {case('b', lb.ACTIVITY, 0.5)})::DOUBLE"
one("diplotype_phenotypes", DIPLOTYPES, lambda d: d.select("diplotype", lb.activity(F.col("diplotype")).alias("activity"), lb.metabolizer(lb.activity(F.col("diplotype"))).alias("phenotype")), f"SELECT diplotype, {SUM} AS activity, CASE WHEN {SUM} > 2 THEN 'ultrarapid' WHEN {SUM} >= 1.25 THEN 'normal' WHEN {SUM} >= 0.25 THEN 'intermediate' ELSE 'poor' END || '_metabolizer' AS phenotype FROM @")
PEPTIDES = "SELECT p_partkey, substring(upper(replace(p_type || p_name, ' ', '')), 1, CAST(p_size % 12 + 1 AS INT)) AS p FROM part"
one("anchor_binding", PEPTIDES, lambda d: d.select("p_partkey", lb.anchor_score(F.col("p")).alias("score"), (lb.anchor_score(F.col("p")) >= 1).alias("binder")), "WITH s AS (SELECT p_partkey, (CASE WHEN len(p) >= 2 THEN CASE WHEN substr(p, 2, 1) IN ('L', 'V', 'I', 'M') THEN 1 ELSE -0.5 END ELSE 0 END + CASE WHEN len(p) >= 9 THEN CASE WHEN substr(p, 9, 1) IN ('L', 'V', 'I') THEN 1 ELSE -0.5 END ELSE 0 END + CASE WHEN len(p) = 9 THEN 0.5 ELSE -0.25 * abs(len(p) - 9) END)::DOUBLE AS score FROM @) SELECT *, score >= 1 AS binder FROM s")
ALL = "SELECT doc_id, seq FROM dna"
one("mutation_hotspot_motifs", ALL, lambda d: d.select("doc_id", lb.motif_hits(F.col("seq"), lb.HOTSPOTS).cast("long").alias("n")), "SELECT d.doc_id, coalesce(n, 0) AS n FROM dna d LEFT JOIN (SELECT doc_id, CAST(sum(CAST(regexp_matches(k, '^[AT][AG]C') AS INT) + CAST(regexp_matches(k, '^G[CT][AT]') AS INT) + CAST(regexp_matches(k, '^[AT]A') AS INT) + CAST(regexp_matches(k, '^T[AT]') AS INT)) AS BIGINT) AS n FROM (SELECT doc_id, substr(seq, i, 3) AS k FROM (SELECT doc_id, seq, unnest(range(1, len(seq) + 1)) AS i FROM dna)) GROUP BY doc_id) x ON x.doc_id = d.doc_id")
HITS = " + ".join(f"len(regexp_extract_all(seq, '{m}'))" for m in lb.VIRAL)
one("viral_contigs", ALL, lambda d: d.select("doc_id", F.round(lb.viral_score(F.col("seq")), 7).alias("score")), f"SELECT doc_id, round(0.5::DOUBLE * len(regexp_replace(seq, '[AT]', '', 'g')) / greatest(len(seq), 1) + 0.5::DOUBLE * tanh(({HITS}) / 5), 7) AS score FROM @")
one("strain_variants", "SELECT event_id, user_id % 40 AS rc, event_id % 9 AS ac FROM events", lambda d: d.select("event_id", lb.strain_variant(F.col("rc"), F.col("ac")).alias("variant")), "SELECT event_id, rc + ac >= 10 AND ac / greatest(rc + ac, 1) >= 0.02 AS variant FROM @")
one("hypermutation_rate", "SELECT a.doc_id AS k, substring(a.seq, 1, 90) AS s, substring(b.seq, 1, 80) AS g FROM dna a JOIN dna b ON b.doc_id = a.doc_id + 1", lambda d: d.select("k", F.round(lb.mutation_rate(F.col("s"), F.col("g")), 8).alias("rate")), "SELECT k, round(CASE WHEN least(len(s), len(g)) > 0 THEN hamming(substr(s, 1, least(len(s), len(g))), substr(g, 1, least(len(s), len(g)))) / least(len(s), len(g)) ELSE 0 END, 8) AS rate FROM @")
SURVIVAL = "SELECT time, status, id % 97 AS marker FROM survival"
one("survival_roc", SURVIVAL, lambda d: lb.roc(d, (F.col("time") <= 200) & (F.col("status") > 0), F.col("time") > 200, "marker").select("threshold", r("tpr"), r("fpr"), r("area")), "WITH n AS (SELECT marker, count_if(time <= 200 AND status > 0) AS e, count_if(time > 200) AS c FROM @ GROUP BY marker HAVING count_if(time <= 200 AND status > 0) + count_if(time > 200) > 0), s AS (SELECT marker, e, c, sum(e) OVER w / sum(e) OVER () AS tpr, sum(c) OVER w / sum(c) OVER () AS fpr, e / sum(e) OVER () AS de, c / sum(c) OVER () AS dc FROM n WINDOW w AS (ORDER BY marker DESC)) SELECT marker AS threshold, round(tpr, 7) AS tpr, round(fpr, 7) AS fpr, round(sum(dc * (tpr - de / 2)) OVER (ORDER BY marker DESC), 7) AS area FROM s")
DEPTHS = "SELECT chrom, CAST(floor(pos / 200) AS BIGINT) AS bin, count(*) AS depth FROM variants GROUP BY 1, 2"
one("copy_number", DEPTHS, lambda d: lb.copy_number(d, ["chrom"], "bin", "depth", 10).select("chrom", "bin", r("log2_ratio", 6), "call"), "WITH s AS (SELECT chrom, bin, median(depth) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM @), x AS (SELECT chrom, bin, log2(greatest(s / avg(s) OVER (PARTITION BY chrom), 1e-6)) AS l FROM s) SELECT chrom, bin, round(l, 6) + 0 AS log2_ratio, CASE WHEN l >= 0.3 THEN 'gain' WHEN l <= -0.3 THEN 'loss' ELSE 'neutral' END AS call FROM x")
