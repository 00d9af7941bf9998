"""Queries of trees, communities on trees, residues, cohorts and proteins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.operators import cohort, phylogeny, residues
from strandlake.plans.views import duck, query, view

QUERIES, ORACLE_SQL = {}, {}


def put(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = duck(sql)


def r(column, digits=7):
    return F.round(column, digits).alias(column)


TREES = (
    "SELECT c_custkey AS tree_id, c_custkey % 3 AS shape, c_custkey % 5 + 1 AS a, c_custkey % 7 + 1 AS b, c_nationkey + 1 AS c, CASE c_custkey % 3 "
    "WHEN 0 THEN '((A:' || CAST(c_custkey % 5 + 1 AS STRING) || ',B:' || CAST(c_custkey % 7 + 1 AS STRING) || '):1,(C:2,D:' || CAST(c_nationkey + 1 AS STRING) || '):3,E:4);' "
    "WHEN 1 THEN '((A:' || CAST(c_custkey % 5 + 1 AS STRING) || ',C:2):1,(B:' || CAST(c_custkey % 7 + 1 AS STRING) || ',D:' || CAST(c_nationkey + 1 AS STRING) || '):3,E:4);' "
    "ELSE '(((A:' || CAST(c_custkey % 5 + 1 AS STRING) || ',B:' || CAST(c_custkey % 7 + 1 AS STRING) || '):1,C:2):3,D:' || CAST(c_nationkey + 1 AS STRING) || ',E:4);' END AS newick FROM customer"
)
put("tree_summary", lambda s, d: phylogeny.tree_summary(query(s, d, TREES)), f"SELECT tree_id, 5 AS leaves, 3 AS inner, true AS bifurcating, CAST(a + b + c + 10 AS DOUBLE) AS length FROM ({TREES})")
SIDES = "(0, 'A', 'B', 0, 0), (0, 'A', 'C', 4, 2), (0, 'A', 'D', 4, 0), (0, 'A', 'E', 1, 4), (0, 'B', 'C', 4, 2), (0, 'B', 'D', 4, 0), (0, 'B', 'E', 1, 4), (0, 'C', 'D', 0, 2), (0, 'C', 'E', 3, 6), (0, 'D', 'E', 3, 4), (1, 'A', 'B', 4, 0), (1, 'A', 'C', 0, 2), (1, 'A', 'D', 4, 0), (1, 'A', 'E', 1, 4), (1, 'B', 'C', 4, 2), (1, 'B', 'D', 0, 0), (1, 'B', 'E', 3, 4), (1, 'C', 'D', 4, 2), (1, 'C', 'E', 1, 6), (1, 'D', 'E', 3, 4), (2, 'A', 'B', 0, 0), (2, 'A', 'C', 1, 2), (2, 'A', 'D', 4, 0), (2, 'A', 'E', 4, 4), (2, 'B', 'C', 1, 2), (2, 'B', 'D', 4, 0), (2, 'B', 'E', 4, 4), (2, 'C', 'D', 3, 2), (2, 'C', 'E', 3, 6), (2, 'D', 'E', 0, 4)"
put(
    "leaf_distances", lambda s, d: phylogeny.leaf_distances(query(s, d, TREES)),
    f"SELECT tree_id, x AS a, y AS b, CAST(CASE WHEN 'A' IN (x, y) THEN t.a ELSE 0 END + CASE WHEN 'B' IN (x, y) THEN t.b ELSE 0 END + CASE WHEN 'D' IN (x, y) THEN t.c ELSE 0 END + way + own AS DOUBLE) AS distance FROM ({TREES}) t JOIN (VALUES {SIDES}) v(shape, x, y, way, own) USING (shape)",
)
put(
    "clade_support", lambda s, d: phylogeny.clade_support(query(s, d, TREES)).select(F.array_join("leaves", "").alias("clade"), "trees", r("share")),
    f"WITH c AS (SELECT shape, count(*) AS n FROM ({TREES}) GROUP BY 1), v AS (SELECT * FROM (VALUES (0, 'AB'), (0, 'CD'), (1, 'AC'), (1, 'BD'), (2, 'AB'), (2, 'ABC')) v(shape, clade)) SELECT clade, CAST(sum(n) AS BIGINT) AS trees, round(sum(n) / (SELECT sum(n) FROM c), 7) AS share FROM c JOIN v USING (shape) GROUP BY clade",
)
put(
    "midpoint_distances", lambda s, d: phylogeny.leaf_distances(query(s, d, TREES).select("tree_id", phylogeny.map_trees(F.col("newick"), phylogeny.Tree.midpoint_root).alias("newick"))),
    ORACLE_SQL["leaf_distances"],
)
COMMUNITY = "SELECT gene AS sample, sample AS leaf, count AS n FROM counts"
PATHS = "SELECT n_name AS leaf, n_name AS node, CAST(n_nationkey % 3 + 1 AS DOUBLE) AS length FROM nation UNION ALL SELECT n_name AS leaf, r_name AS node, 2.5E0 AS length FROM nation JOIN region ON n_regionkey = r_regionkey"
SHARES = f"SELECT sample, node, length, sum(n) / any_value(t) AS share FROM (SELECT c.sample, p.node, p.length, c.n, sum(n) FILTER (p.node = c.leaf) OVER (PARTITION BY c.sample) AS t FROM ({COMMUNITY}) c JOIN ({PATHS}) p USING (leaf) WHERE n > 0) GROUP BY ALL"
put("faith_pd", lambda s, d: phylogeny.faith_pd(query(s, d, COMMUNITY), query(s, d, PATHS)), f"SELECT sample, sum(length) AS pd FROM ({SHARES}) GROUP BY 1")
put(
    "unifrac", lambda s, d: phylogeny.unifrac(query(s, d, COMMUNITY), query(s, d, PATHS)).withColumn("distance", r("distance")),
    f"WITH s AS ({SHARES}), x AS (SELECT DISTINCT sample FROM s), n AS (SELECT DISTINCT node, length FROM s) SELECT x.sample AS a, y.sample AS b, round(sum(length) FILTER ((p.node IS NULL) <> (q.node IS NULL)) / sum(length) FILTER (p.node IS NOT NULL OR q.node IS NOT NULL), 7) AS distance FROM x JOIN x y ON x.sample < y.sample CROSS JOIN n LEFT JOIN s p ON p.sample = x.sample AND p.node = n.node LEFT JOIN s q ON q.sample = y.sample AND q.node = n.node GROUP BY 1, 2".replace("round(sum(length) FILTER", "round(coalesce(sum(n.length) FILTER", 1).replace("IS NULL)) / sum(length)", "IS NULL)), 0) / sum(n.length)"),
)
put(
    "weighted_unifrac", lambda s, d: phylogeny.unifrac(query(s, d, COMMUNITY), query(s, d, PATHS), weighted=True).withColumn("distance", r("distance")),
    f"WITH s AS ({SHARES}), x AS (SELECT DISTINCT sample FROM s), n AS (SELECT DISTINCT node, length FROM ({PATHS})) SELECT x.sample AS a, y.sample AS b, round(sum(n.length * abs(coalesce(p.share, 0) - coalesce(q.share, 0))) / (SELECT sum(length) FROM n), 7) AS distance FROM x JOIN x y ON x.sample < y.sample CROSS JOIN n LEFT JOIN s p ON p.sample = x.sample AND p.node = n.node LEFT JOIN s q ON q.sample = y.sample AND q.node = n.node GROUP BY 1, 2",
)
put("structure_summary", lambda s, d: residues.structure_summary(view(s, d, "atoms")), "SELECT structure, count(DISTINCT chain) AS chains, count(DISTINCT (chain, resseq)) AS residues, count(*) AS atoms, 0 AS water_atoms, 0 AS ligand_atoms FROM atoms GROUP BY 1")
put("chain_summary", lambda s, d: residues.chain_summary(view(s, d, "atoms")).withColumn("bfactor", r("bfactor")), "SELECT structure, chain, count(DISTINCT resseq) AS residues, count(*) AS atoms, min(resseq) AS first, max(resseq) AS last, round(avg(bfactor), 7) AS bfactor FROM atoms GROUP BY 1, 2")
put("residue_bfactor", lambda s, d: residues.residue_bfactor(view(s, d, "atoms")).withColumn("bfactor", r("bfactor")), "SELECT structure, chain, resseq, min(residue) AS residue, round(avg(bfactor), 7) AS bfactor, max(bfactor) AS highest FROM atoms GROUP BY 1, 2, 3")
put("select_atoms", lambda s, d: residues.select_atoms(view(s, d, "atoms"), "chain A B and (name CA or resname GLY) and not resid 5:20").select("structure", "id"), "SELECT structure, id FROM atoms WHERE chain IN ('A', 'B') AND (atom = 'CA' OR residue = 'GLY') AND NOT resseq BETWEEN 5 AND 20")
put("residue_distances", lambda s, d: residues.residue_distances(view(s, d, "atoms"), 6.0).select("structure", "a", "b", r("distance")), "SELECT structure, a, b, round(distance, 7) AS distance FROM (SELECT p.structure, p.id AS a, q.id AS b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS distance FROM atoms p JOIN atoms q ON p.structure = q.structure AND p.id < q.id AND abs(p.x - q.x) <= 6 WHERE p.atom = 'CA' AND q.atom = 'CA') WHERE distance <= 6")
put("interface_residues", lambda s, d: residues.interface_residues(view(s, d, "atoms")), "WITH e AS (SELECT p.structure, p.chain AS c, p.resseq AS s, q.chain AS c2, q.resseq AS s2 FROM atoms p JOIN atoms q ON p.structure = q.structure AND p.id < q.id AND p.chain <> q.chain AND abs(p.x - q.x) <= 5 WHERE sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) <= 5) SELECT structure, chain, resseq, count(*) AS contacts FROM (SELECT structure, c AS chain, s AS resseq FROM e UNION ALL SELECT structure, c2, s2 FROM e) GROUP BY 1, 2, 3")
put("hydrogen_bonds", lambda s, d: residues.hydrogen_bonds(view(s, d, "atoms"), 6.0, 90.0).select("structure", "donor_chain", "donor_resseq", "acceptor_chain", "acceptor_resseq", r("distance", 6)))
put("ramachandran_profile", lambda s, d: residues.ramachandran_profile(view(s, d, "atoms")).groupBy("structure", "region").agg(F.count(F.lit(1)).alias("n")))
put("sample_report", lambda s, d: cohort.sample_report(view(s, d, "genotypes")).select("sample", r("call_rate"), r("het"), r("het_z", 5), "passes"), "WITH o AS (SELECT sample, count(dosage) / count(*) AS c, CASE WHEN count(dosage) > 0 THEN count_if(dosage = 1) / count(dosage) END AS h FROM genotypes GROUP BY 1), z AS (SELECT *, (h - avg(h) OVER ()) / stddev_samp(h) OVER () AS z FROM o) SELECT sample, round(c, 7) AS call_rate, round(h, 7) AS het, round(z, 5) AS het_z, 1 - c <= 0.05 AND coalesce(abs(z) <= 3, false) AS passes FROM z")
put("sex_check", lambda s, d: cohort.sex_check(query(s, d, "SELECT sample, dosage, CASE snp % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN '24' ELSE '1' END AS chrom FROM genotypes")).select("sample", r("x_het"), r("y_het"), "inferred"), "WITH h AS (SELECT sample, count_if(snp % 4 = 0 AND dosage = 1) / nullif(count_if(snp % 4 = 0 AND dosage IS NOT NULL), 0) AS x, count_if(snp % 4 = 1 AND dosage = 1) / nullif(count_if(snp % 4 = 1 AND dosage IS NOT NULL), 0) AS y FROM genotypes GROUP BY 1) SELECT sample, round(x, 7) AS x_het, round(y, 7) AS y_het, CASE WHEN x >= 0.2 THEN 'F' WHEN x <= 0.05 THEN 'M' ELSE 'unknown' END AS inferred FROM h")
KIN = "SELECT l_suppkey AS sample, l_partkey AS snp, max(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 3 END) AS dosage FROM lineitem GROUP BY 1, 2"
put("kinship", lambda s, d: cohort.kinship(query(s, d, KIN)).withColumn("kinship", r("kinship", 6)), f"WITH g AS (SELECT * FROM ({KIN}) WHERE dosage IS NOT NULL), f AS (SELECT snp, avg(dosage) / 2 AS p FROM g GROUP BY 1), w AS (SELECT sample, g.snp, dosage - 2 * p AS c, 2 * p * (1 - p) AS v FROM g JOIN f USING (snp) WHERE 2 * p * (1 - p) > 1e-15) SELECT a.sample AS a, b.sample AS b, round(sum(a.c * b.c) / (2 * sum(a.v)), 6) AS kinship FROM w a JOIN w b ON a.snp = b.snp AND a.sample <= b.sample GROUP BY 1, 2")
P = "SELECT CAST(o_orderkey * 7919 % 100003 + 1 AS DOUBLE) / 100003 AS p FROM orders"
put("qq_data", lambda s, d: cohort.qq(query(s, d, P)).select(r("p", 9), r("observed"), r("expected")), f"SELECT round(p, 9) AS p, round(-log10(p), 7) AS observed, round(-log10((row_number() OVER (ORDER BY p) - 0.5::DOUBLE) / count(*) OVER ()), 7) AS expected FROM ({P})")
EFFECTS = "SELECT CAST(o_orderkey % 97 + 3 AS DOUBLE) / 50 - 1.01E0 AS beta_exp, 2.0E-2 AS se_exp, CAST(o_custkey % 89 AS DOUBLE) / 60 - 7E-1 AS beta_out, CAST(o_orderkey % 11 + 2 AS DOUBLE) / 40 AS se_out FROM orders"
put("pleiotropy_test", lambda s, d: cohort.pleiotropy(query(s, d, EFFECTS)).select(r("q", 3), "df"), f"WITH e AS ({EFFECTS}), b AS (SELECT sum(beta_exp * beta_out / (se_out * se_out)) / sum(beta_exp * beta_exp / (se_out * se_out)) AS b FROM e) SELECT round(sum(pow(beta_out / beta_exp - b, 2) / (pow(se_out / beta_exp, 2) + pow(beta_out * se_exp, 2) / pow(beta_exp, 4))), 3) AS q, count(*) - 1 AS df FROM e, b")
put("egger_regression", lambda s, d: cohort.egger(query(s, d, EFFECTS)).select(r("intercept"), r("slope")), f"WITH e AS (SELECT abs(beta_exp) AS x, beta_out * sign(beta_exp) AS y, 1 / (se_out * se_out) AS w FROM ({EFFECTS})), s AS (SELECT sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM e), l AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS b FROM s) SELECT round((y - b * x) / w, 7) AS intercept, round(b, 7) AS slope FROM l")
put("chromosome_names", lambda s, d: view(s, d, "variants").select("id", cohort.normalise_chromosome(F.concat(F.lit(" Chr"), (F.col("user_id") % 27).cast("string"))).alias("chrom")), "SELECT id, CASE user_id % 27 WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'XY' WHEN 26 THEN 'MT' ELSE CAST(user_id % 27 AS STRING) END AS chrom FROM variants")


def hazards(s, d):
    rows = query(s, d, "SELECT time, status, CAST(id % 7 AS DOUBLE) / 7 AS x, CASE WHEN grp = 'BUILDING' THEN 1 ELSE 0 END AS building FROM survival")
    return s.createDataFrame(cohort.cox(rows, "time", "status", ["x", "building"]), "term string, beta double, se double, z double").select("term", r("beta", 6), r("se", 6), r("z", 5))


put("proportional_hazards", hazards)
PROTEINS = "SELECT doc_id, seq FROM reads"


def charged(s, d):
    return query(s, d, PROTEINS).select("doc_id", F.translate(sq.translate_dna(F.col("seq")), "*", "").alias("p")).select("doc_id", F.round(sq.isoelectric_point(F.col("p")), 3).alias("pi"))


put("isoelectric_point", charged)
weight = "+".join(f"{w}::DOUBLE * (len(seq) - len(replace(seq, '{b}', '')))" for b, w in sq.NUCLEOTIDE_WEIGHT.items())
put("dna_weight", lambda s, d: view(s, d, "dna").select("doc_id", F.round(sq.dna_weight(F.col("seq")), 4).alias("weight")), f"SELECT doc_id, round(CASE WHEN len(seq) = 0 THEN 0.0::DOUBLE ELSE {weight} - 61.96 END, 4) AS weight FROM dna")
WEIGHTS = "SELECT a || b AS pair, CAST(ascii(a) * 7 + ascii(b) * 3 AS DOUBLE) / 10 - 60 AS weight FROM (SELECT {0} AS a) JOIN (SELECT {0} AS b) ON true"


def instability(s, d):
    letters = "explode(split('ACDEFGHIKLMNPQRSTVWY', ''))"
    return sq.instability_index(query(s, d, PROTEINS).select("doc_id", F.translate(sq.translate_dna(F.col("seq")), "*", "").alias("p")), s.sql(WEIGHTS.format(letters)), "doc_id", "p").select("doc_id", r("instability", 6))


put("instability_index", instability)
put("pcr_products", lambda s, d: sq.pcr_products(view(s, d, "dna"), "seq", "TAAT", "AATA", 200), "WITH k AS (SELECT doc_id, i AS pos, substr(seq, i, 4) AS k FROM (SELECT doc_id, seq, unnest(range(1, len(seq) - 2)) AS i FROM dna)), f AS (SELECT doc_id, pos FROM k WHERE k = 'TAAT'), b AS (SELECT doc_id, pos + 3 AS stop FROM k WHERE k = 'TATT') SELECT f.doc_id, pos AS start, stop, stop - pos + 1 AS size FROM f JOIN b ON f.doc_id = b.doc_id AND stop - pos + 1 BETWEEN 8 AND 200")
