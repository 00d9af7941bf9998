"""Queries of genotype quality control, association and population genetics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import genetics as g
from strandlake.plans.views import duck, query

QUERIES, ORACLE_SQL = {}, {}


def one(name, source, operator, sql):
    text = source if " " in source else f"SELECT * FROM {source}"
    QUERIES[name] = lambda s, d: operator(query(s, d, text))
    if sql:
        ORACLE_SQL[name] = duck(sql.replace("@", f"({text})"))


def r(column, digits=8):
    return F.round(column, digits).alias(column)


FREQ = "SELECT {by}, avg(dosage) / 2 AS f, avg(CASE WHEN dosage IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM genotypes GROUP BY {by}"
one("calculate_maf", "genotypes", lambda d: g.allele_frequency(d).select("snp", r("freq"), r("maf"), r("missing"), r("call_rate")), f"SELECT snp, round(f, 8) AS freq, round(least(f, 1 - f), 8) AS maf, round(m, 8) AS missing, round(1 - m, 8) AS call_rate FROM ({FREQ.format(by='snp')})")
one("sample_missingness", "genotypes", lambda d: g.allele_frequency(d, ("sample",)).select("sample", r("missing")), f"SELECT sample, round(m, 8) AS missing FROM ({FREQ.format(by='sample')})")
one("filter_variants", "genotypes", lambda d: g.filter_variants(d, 0.3, 0.06).groupBy("snp").agg(F.count(F.lit(1)).alias("n")), f"SELECT snp, count(*) AS n FROM genotypes WHERE snp IN (SELECT snp FROM ({FREQ.format(by='snp')}) WHERE least(f, 1 - f) >= 0.3 AND m <= 0.06) GROUP BY snp")
COUNTS = "SELECT snp, CAST(count_if(dosage = 0) AS BIGINT) AS hom_ref, CAST(count_if(dosage = 1) AS BIGINT) AS het, CAST(count_if(dosage = 2) AS BIGINT) AS hom_alt FROM genotypes GROUP BY snp"
one("genotype_counts", "genotypes", g.genotype_counts, COUNTS)
one("hardy_weinberg", "genotypes", lambda d: g.hardy_weinberg(d).select("snp", "hom_ref", "het", "hom_alt", r("chi_square", 5)), f"WITH c AS ({COUNTS}), p AS (SELECT *, hom_ref + het + hom_alt AS n, (2 * hom_alt + het) / (2 * (hom_ref + het + hom_alt)) AS p FROM c) SELECT snp, hom_ref, het, hom_alt, round(pow(hom_ref - n * pow(1 - p, 2), 2) / (n * pow(1 - p, 2)) + pow(het - 2 * n * p * (1 - p), 2) / (2 * n * p * (1 - p)) + pow(hom_alt - n * p * p, 2) / (n * p * p), 5) AS chi_square FROM p")
one("hwe_exact_pvalues", "genotypes", lambda d: g.hardy_weinberg(d).select("snp", "pvalue"), None)
one("heterozygosity", "genotypes", lambda d: g.heterozygosity(d).select("pop", "snp", r("observed"), r("expected"), r("inbreeding", 6)), "SELECT pop, snp, round(o, 8) AS observed, round(e, 8) AS expected, round(CASE WHEN e > 0 THEN 1 - o / e ELSE 0 END, 6) AS inbreeding FROM (SELECT pop, snp, avg(CASE WHEN dosage = 1 THEN 1.0 ELSE 0.0 END) AS o, 2 * (avg(dosage) / 2) * (1 - avg(dosage) / 2) AS e FROM genotypes WHERE dosage IS NOT NULL GROUP BY pop, snp)")
one("fixation_index", "genotypes", lambda d: g.fixation(d).select("snp", r("fst", 7)), "WITH p AS (SELECT snp, pop, avg(dosage) / 2 AS p FROM genotypes WHERE dosage IS NOT NULL GROUP BY 1, 2), s AS (SELECT snp, avg(p) AS m, avg(2 * p * (1 - p)) AS hs FROM p GROUP BY snp) SELECT snp, round(CASE WHEN 2 * m * (1 - m) > 0 THEN greatest((2 * m * (1 - m) - hs) / (2 * m * (1 - m)), 0) ELSE 0 END, 7) AS fst FROM s")
one("linkage_r2", "genotypes", lambda d: g.linkage(d, 400).select("a", "b", "n", r("r2", 7)), "SELECT x.snp AS a, y.snp AS b, count(*) AS n, round(pow(corr(x.dosage, y.dosage), 2), 7) AS r2 FROM genotypes x JOIN genotypes y ON x.sample = y.sample AND x.snp < y.snp AND y.snp - x.snp <= 400 WHERE x.dosage IS NOT NULL AND y.dosage IS NOT NULL GROUP BY 1, 2")
SOME = "SELECT * FROM genotypes"
one("identity_by_state", SOME, lambda d: g.identity_by_state(d).select("a", "b", "n", r("ibs")), "SELECT x.sample AS a, y.sample AS b, count(*) AS n, round(avg(CASE WHEN x.dosage = y.dosage THEN 1.0 ELSE 0.0 END), 8) AS ibs FROM @ x JOIN @ y ON x.snp = y.snp AND x.sample < y.sample WHERE x.dosage IS NOT NULL AND y.dosage IS NOT NULL GROUP BY 1, 2")
PHENOTYPE = "SELECT c_custkey AS sample, c_acctbal AS y FROM customer"
QUERIES["gwas_linear_scan"] = lambda s, d: g.linear_scan(query(s, d, "SELECT * FROM genotypes"), query(s, d, PHENOTYPE)).select("snp", "n", r("beta", 4), r("se", 4), r("t", 5))
ORACLE_SQL["gwas_linear_scan"] = duck(f"WITH j AS (SELECT snp, dosage::DOUBLE AS x, y FROM genotypes g JOIN ({PHENOTYPE}) p ON g.sample = p.sample WHERE dosage IS NOT NULL), s AS (SELECT snp, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS vx, regr_syy(y, x) AS vy, regr_sxy(y, x) AS vxy FROM j GROUP BY snp) SELECT snp, n, round(b, 4) AS beta, round(sqrt((vy - b * vxy) / (n - 2) / vx), 4) AS se, round(b / sqrt((vy - b * vxy) / (n - 2) / vx), 5) AS t FROM s WHERE vx > 1e-12 AND n > 2")
BETAS = "SELECT p_partkey AS snp, CAST(p_size AS DOUBLE) / 50 AS beta FROM part"
QUERIES["polygenic_score"] = lambda s, d: g.polygenic_score(query(s, d, "SELECT * FROM genotypes"), query(s, d, BETAS)).select("sample", r("score", 6))
ORACLE_SQL["polygenic_score"] = duck(f"SELECT sample, round(sum(coalesce(dosage, 0) * beta), 6) AS score FROM genotypes g JOIN ({BETAS}) b ON g.snp = b.snp GROUP BY sample")
STUDIES = "SELECT p_partkey % 200 AS snp, p_size AS study, p_retailprice / 1000 - 1 AS beta, 0.05 + CAST(p_size AS DOUBLE) / 100 AS se FROM part"
one("meta_analysis", STUDIES, lambda d: g.meta_analysis(d).select("snp", "k", *[r(c, 6) for c in ("beta_fixed", "se_fixed", "q", "tau2", "i2", "beta_random", "se_random")]), "WITH x AS (SELECT *, 1 / (se * se) AS w FROM @), s AS (SELECT snp, count(*) AS k, sum(w) AS w, sum(w * beta) AS wb, sum(w * w) AS ww, greatest(sum(w * beta * beta) - pow(sum(w * beta), 2) / sum(w), 0) AS q FROM x GROUP BY snp), t AS (SELECT *, CASE WHEN k > 1 THEN greatest((q - (k - 1)) / (w - ww / w), 0) ELSE 0 END AS tau2 FROM s), v AS (SELECT t.snp, sum(beta / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS br, sqrt(1 / sum(1 / (se * se + tau2))) AS sr FROM x JOIN t ON x.snp = t.snp GROUP BY t.snp) SELECT t.snp, k, round(wb / w, 6) AS beta_fixed, round(sqrt(1 / w), 6) AS se_fixed, round(q, 6) AS q, round(tau2, 6) AS tau2, round(CASE WHEN q > 0 THEN greatest((q - (k - 1)) / q, 0) ELSE 0 END, 6) AS i2, round(br, 6) AS beta_random, round(sr, 6) AS se_random FROM t JOIN v ON t.snp = v.snp")
HITS = "SELECT chrom, pos, (event_id % 1000 + 1) / 1000.0 AS p FROM variants"
one("manhattan_data", "SELECT chrom, pos, CAST(event_id % 1000 + 1 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p FROM variants", lambda d: g.manhattan(d, 0.01).withColumn("logp", r("logp")), "WITH e AS (SELECT chrom, max(pos) AS l, CAST(replace(chrom, 'chr', '') AS INT) AS k FROM @ GROUP BY 1), o AS (SELECT chrom, coalesce(sum(l) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e) SELECT v.chrom, pos, CAST(pos + b AS BIGINT) AS x, round(-log10(p), 8) + 0 AS logp, p <= 0.01 AS significant FROM @ v JOIN o ON v.chrom = o.chrom")
one("locus_zoom", "SELECT chrom, pos, id, CAST(event_id % 1000 + 1 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p FROM variants", lambda d: d.where((F.col("chrom") == "chr7") & F.col("pos").between(1000, 6000)).select("id", "pos", F.round(-F.log10("p"), 8).alias("logp")), "SELECT id, pos, round(-log10(p), 8) + 0 AS logp FROM @ WHERE chrom = 'chr7' AND pos BETWEEN 1000 AND 6000")
one("dosage_hardcall", "SELECT DISTINCT CAST(event_id % 250 AS DOUBLE) / CAST(100 AS DOUBLE) AS d FROM events", lambda d: d.select("d", g.hard_call(F.col("d"), 0.105).alias("call")), "SELECT d, CASE WHEN abs(d - round_even(d, 0)) <= 0.105 THEN CAST(least(greatest(round_even(d, 0), 0), 2) AS INT) END AS call FROM @")
ALLELES = "SELECT event_id AS snp, ref AS a1, alt AS a2, CAST(user_id AS DOUBLE) / 100 AS beta FROM variants"
OTHER = "SELECT event_id AS snp, CASE event_id % 3 WHEN 0 THEN alt WHEN 1 THEN ref ELSE translate(ref, 'ACGT', 'TGCA') END AS a1, CASE event_id % 3 WHEN 0 THEN ref WHEN 1 THEN alt ELSE translate(alt, 'ACGT', 'TGCA') END AS a2, CAST(user_id AS DOUBLE) / 50 AS beta FROM variants WHERE event_id % 2 = 0"
QUERIES["harmonise_alleles"] = lambda s, d: g.harmonise(query(s, d, ALLELES), query(s, d, OTHER))
ORACLE_SQL["harmonise_alleles"] = duck(f"SELECT a.snp, a.a1, a.a2, a.beta AS beta_a, CASE WHEN a.snp % 3 = 0 THEN -b.beta ELSE b.beta END AS beta_b FROM ({ALLELES}) a JOIN ({OTHER}) b ON a.snp = b.snp WHERE a.a1 <> translate(a.a2, 'ACGT', 'TGCA')")
PIPS = "SELECT l_suppkey AS locus, l_partkey AS snp, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY l_suppkey, l_partkey"
one("credible_set", f"SELECT locus, snp, q / sum(q) OVER (PARTITION BY locus) AS pip FROM ({PIPS})", lambda d: g.credible_set(d, 0.4997).select("locus", "snp"), "SELECT locus, snp FROM @ QUALIFY coalesce(sum(pip) OVER (PARTITION BY locus ORDER BY pip DESC, snp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.4997")
