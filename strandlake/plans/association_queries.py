"""Queries of association statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import association as asn
from strandlake.plans.views import duck, query

QUERIES, ORACLE_SQL = {}, {}
ALL = "SELECT * FROM genotypes"


def put(name, run, sql):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = duck(sql)


def r(column, digits=6):
    return F.round(column, digits).alias(column)


Z = "SELECT p_partkey AS snp, (p_retailprice - 1450) / 300 AS z FROM part"
put("genomic_control", lambda s, d: asn.genomic_control(query(s, d, Z)).select("snp", r("lambda"), r("z_adjusted")), f"WITH z AS ({Z}), l AS (SELECT median(z * z) / 0.4549::DOUBLE AS l FROM z) SELECT snp, round(l, 6) AS lambda, round(z / sqrt(greatest(l, 1)), 6) AS z_adjusted FROM z, l")
P = "SELECT p_partkey AS id, CAST(p_partkey * 37 % 1009 + 1 AS DOUBLE) / CAST(1010 AS DOUBLE) AS p FROM part"
put("storey_qvalues", lambda s, d: asn.storey(query(s, d, P), "p", "id").select("id", r("pi0"), r("q")), f"WITH k AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS m FROM ({P})), o AS (SELECT least(count_if(p > 0.5) / (0.5 * count(*)), 1) AS pi0 FROM k) SELECT id, round(pi0, 6) AS pi0, round(pi0 * least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 6) AS q FROM k, o")
STATUS = "SELECT c_custkey AS sample, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS status FROM customer"
put("trend_test", lambda s, d: asn.trend_test(query(s, d, ALL), query(s, d, STATUS)).select("snp", "n", "cases", r("chi_square")), f"WITH j AS (SELECT snp, dosage::DOUBLE AS x, status::DOUBLE AS y FROM genotypes g JOIN ({STATUS}) t ON t.sample = g.sample WHERE dosage IS NOT NULL) SELECT snp, count(*) AS n, CAST(sum(y) AS BIGINT) AS cases, round(count(*) * pow(corr(x, y), 2), 6) AS chi_square FROM j GROUP BY snp")
put("genotype_table", lambda s, d: asn.genotype_table(query(s, d, ALL), query(s, d, STATUS)), "SELECT snp, " + ", ".join(f"CAST(count_if(dosage = {g} AND status = {v}) AS BIGINT) AS {n}{g}" for v, n in ((1, "a"), (0, "c")) for g in (0, 1, 2)) + f" FROM genotypes g JOIN ({STATUS}) t ON t.sample = g.sample WHERE dosage IS NOT NULL GROUP BY snp")
put("logistic_scan", lambda s, d: asn.logistic_scan(query(s, d, ALL), query(s, d, STATUS)), None)
SUMMARY = "SELECT p_partkey AS snp, p_size AS locus, (p_retailprice - 1450) / 1000 AS beta, CAST(0.1 AS DOUBLE) + CAST(p_size AS DOUBLE) / 500 AS se FROM part"
LABF = "0.5::DOUBLE * (ln(1 - 0.04::DOUBLE / (se * se + 0.04::DOUBLE)) + 0.04::DOUBLE / (se * se + 0.04::DOUBLE) * pow(beta / se, 2))"
put("inclusion_probability", lambda s, d: asn.inclusion_probability(query(s, d, SUMMARY), "locus").select("snp", "locus", r("pip", 8)), f"SELECT snp, locus, round(exp(l) / sum(exp(l)) OVER (PARTITION BY locus), 8) AS pip FROM (SELECT *, {LABF} AS l FROM ({SUMMARY}))")
OTHER = "SELECT p_partkey AS snp, (p_retailprice - 1400) / 1100 AS beta, CAST(0.12 AS DOUBLE) + CAST(p_size AS DOUBLE) / 400 AS se FROM part"
put("colocalisation", lambda s, d: asn.colocalisation(query(s, d, SUMMARY), query(s, d, OTHER)).select(*[r(f"pp{i}", 7) for i in range(5)]), f"WITH j AS (SELECT a.l AS x, b.l AS y FROM (SELECT snp, {LABF} AS l FROM ({SUMMARY})) a JOIN (SELECT snp, {LABF} AS l FROM ({OTHER})) b USING (snp)), s AS (SELECT sum(exp(x)) AS x, sum(exp(y)) AS y, sum(exp(x + y)) AS z FROM j), h AS (SELECT 1.0::DOUBLE AS h0, x * 1e-4 AS h1, y * 1e-4 AS h2, (x * y - z) * 1e-8 AS h3, z * 1e-5 AS h4 FROM s) SELECT " + ", ".join(f"round(h{i} / (h0 + h1 + h2 + h3 + h4), 7) AS pp{i}" for i in range(5)) + " FROM h")
EFFECTS = "SELECT p_partkey AS snp, (p_retailprice - 1450) / 1000 AS bx, (p_retailprice - 1450) / 1500 + CAST(p_size AS DOUBLE) / 200 AS by, CAST(0.05 AS DOUBLE) + CAST(p_size AS DOUBLE) / 600 AS se FROM part"
put("mendelian_randomisation", lambda s, d: asn.mendelian_randomisation(query(s, d, EFFECTS)).select("n", *[r(c) for c in ("ivw", "ivw_se", "q", "egger", "intercept")]), f"WITH e AS (SELECT abs(bx) AS x, CASE WHEN bx < 0 THEN -b2 ELSE b2 END AS y, 1 / (se * se) AS w FROM ({EFFECTS.replace(' AS by', ' AS b2')})), s AS (SELECT count(*) AS n, sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy, sum(w * y * y) AS wyy FROM e), t AS (SELECT *, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS b FROM s) SELECT n, round(wxy / wxx, 6) AS ivw, round(sqrt(1 / wxx), 6) AS ivw_se, round(wyy - wxy * wxy / wxx, 6) AS q, round(b, 6) AS egger, round((wy - b * wx) / w, 6) AS intercept FROM t")
put("ld_scores", lambda s, d: asn.ld_scores(query(s, d, ALL), 400).withColumn("ld_score", r("ld_score")), "WITH l AS (SELECT x.snp AS a, y.snp AS b, pow(corr(x.dosage, y.dosage), 2) AS r2 FROM genotypes x JOIN genotypes y ON x.sample = y.sample AND x.snp < y.snp AND y.snp - x.snp <= 400 WHERE x.dosage IS NOT NULL AND y.dosage IS NOT NULL GROUP BY 1, 2), u AS (SELECT a AS snp, r2 FROM l UNION ALL SELECT b, r2 FROM l) SELECT g.snp, round(1 + coalesce(sum(r2), 0), 6) AS ld_score FROM (SELECT DISTINCT snp FROM genotypes) g LEFT JOIN u ON u.snp = g.snp GROUP BY g.snp")
SOME = "SELECT * FROM genotypes"
put("relationship_matrix", lambda s, d: asn.relationship(query(s, d, SOME)).withColumn("relationship", r("relationship")), f"WITH g AS ({SOME}), p AS (SELECT snp, avg(dosage) / 2 AS p FROM g WHERE dosage IS NOT NULL GROUP BY snp), z AS (SELECT g.snp, sample, dosage - 2 * p AS z FROM g JOIN p USING (snp) WHERE dosage IS NOT NULL), k AS (SELECT 2 * sum(p * (1 - p)) AS k FROM p) SELECT x.sample AS a, y.sample AS b, round(sum(x.z * y.z) / max(k), 6) + 0 AS relationship FROM z x JOIN z y ON x.snp = y.snp AND x.sample <= y.sample, k GROUP BY 1, 2")
SETS = "SELECT p_partkey AS snp, p_partkey % 7 AS term FROM part"
PHENOTYPE = "SELECT c_custkey AS sample, c_acctbal AS y FROM customer"
put("burden_test", lambda s, d: asn.burden(query(s, d, ALL), query(s, d, SETS), query(s, d, PHENOTYPE)).select("term", "n", r("beta", 4), r("t", 5)), f"WITH b AS (SELECT term, sample, sum(dosage) AS x FROM genotypes g JOIN ({SETS}) t ON t.snp = g.snp GROUP BY 1, 2), s AS (SELECT term, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS vx, regr_syy(y, x) AS vy, regr_sxy(y, x) AS vxy FROM b JOIN ({PHENOTYPE}) p ON p.sample = b.sample WHERE x IS NOT NULL GROUP BY term) SELECT term, n, round(b, 4) AS beta, round(b / sqrt((vy - b * vxy) / (n - 2) / vx), 5) AS t FROM s")
put("inverse_normal", lambda s, d: asn.inverse_normal(query(s, d, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"), "c_acctbal", ["c_nationkey"]), None)
put("heterozygosity_outliers", lambda s, d: asn.heterozygosity_outliers(query(s, d, ALL), 2.0).select("sample", r("het"), r("z"), "outlier"), "WITH h AS (SELECT sample, avg(CASE WHEN dosage = 1 THEN 1.0 ELSE 0.0 END) AS het FROM genotypes WHERE dosage IS NOT NULL GROUP BY 1), z AS (SELECT *, (het - avg(het) OVER ()) / stddev_samp(het) OVER () AS z FROM h) SELECT sample, round(het, 6) AS het, round(z, 6) + 0 AS z, abs(z) > 2 AS outlier FROM z")
put("score_regression", lambda s, d: asn.score_regression(query(s, d, "SELECT p_retailprice / 1000 AS chi_square, CAST(p_size AS DOUBLE) AS ld_score FROM part"), 50000.0).select("m", r("slope", 9), r("intercept"), r("h2", 9)), "SELECT count(*) AS m, round(regr_slope(c, l), 9) AS slope, round(regr_intercept(c, l), 6) AS intercept, round(regr_slope(c, l) * count(*) / 50000, 9) AS h2 FROM (SELECT p_retailprice / 1000 AS c, CAST(p_size AS DOUBLE) AS l FROM part)")
HITS, MAP = "SELECT chrom, pos, id FROM variants", "SELECT DISTINCT chrom, pos, pos + 1000 AS new_pos FROM variants WHERE pos % 3 = 0"
put("liftover", lambda s, d: asn.liftover(query(s, d, HITS), query(s, d, MAP)), "SELECT chrom, id, CASE WHEN pos % 3 = 0 THEN pos + 1000 ELSE pos END AS pos, pos % 3 = 0 AS mapped FROM variants")
put("permutation_pvalue", lambda s, d: asn.permutation_p(F.lit(20.0), query(s, d, "SELECT value FROM events"), "value").withColumn("pvalue", r("pvalue", 9)), "SELECT round((1 + count_if(abs(value) >= 20)) / (count(*) + 1), 9) AS pvalue FROM events")
