"""Queries of structures, spots, cells and features, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import abundance as ab
from strandlake.operators import cells as cl
from strandlake.operators import features as ft
from strandlake.operators import structure as st
from strandlake.plans.views import duck, query

QUERIES, ORACLE_SQL = {}, {}


def one(name, source, operator, sql):
    text = source if " " in source else f"SELECT * FROM {source}"
    QUERIES[name] = lambda s, d: operator(query(s, d, text))
    if sql:
        ORACLE_SQL[name] = duck(sql.replace("@", f"({text})"))


def r(column, digits=6):
    return F.round(column, digits).alias(column)


MASS = "CASE substr(atom, 1, 1) WHEN 'C' THEN 12.011::DOUBLE WHEN 'N' THEN 14.007::DOUBLE WHEN 'O' THEN 15.999::DOUBLE WHEN 'S' THEN 32.06::DOUBLE END"
CENTER = ", ".join(f"sum(m * {c}) / sum(m) AS {c}" for c in "xyz")
one("center_of_mass", "atoms", lambda d: st.center_of_mass(d, ["structure", "chain"]).select("structure", "chain", *[r(c) for c in "xyz"]), f"SELECT structure, chain, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM (SELECT structure, chain, {CENTER} FROM (SELECT *, {MASS} AS m FROM atoms) GROUP BY 1, 2)")
one("bounding_box", "atoms", lambda d: st.bounding_box(d, ["structure"]), "SELECT structure, " + ", ".join(f"{f}({c}) AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM atoms GROUP BY structure")
one("radius_of_gyration", "atoms", lambda d: st.radius_of_gyration(d, ["structure", "chain"]).select("structure", "chain", r("radius")), f"WITH a AS (SELECT *, {MASS} AS m FROM atoms), c AS (SELECT structure, chain, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * z) / sum(m) AS cz FROM a GROUP BY 1, 2) SELECT structure, chain, round(sqrt(sum(m * (pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))) / sum(m)), 6) AS radius FROM a JOIN c USING (structure, chain) GROUP BY 1, 2")
one("structure_sequences", "atoms", st.sequences, "WITH r AS (SELECT structure, chain, resseq, min(residue) AS r FROM atoms GROUP BY 1, 2, 3) SELECT structure, chain, string_agg(CASE r WHEN 'CYS' THEN 'C' WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' ELSE 'K' END, '' ORDER BY resseq) AS sequence FROM r GROUP BY 1, 2")
DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
one("residue_contacts", "SELECT * FROM atoms WHERE atom = 'CA'", lambda d: st.near_pairs(d, ["structure"], "id", "xyz", 8.0).withColumn("distance", r("distance")), f"SELECT a.structure, a.id AS a, b.id AS b, round({DIST}, 6) AS distance FROM @ a JOIN @ b ON a.structure = b.structure AND a.id < b.id AND {DIST} <= 8")
one("chain_contacts", "atoms", st.chain_contacts, f"SELECT a.structure, least(a.chain, b.chain) AS chain_a, greatest(a.chain, b.chain) AS chain_b, count(*) AS contacts FROM atoms a JOIN atoms b ON a.structure = b.structure AND a.id < b.id AND a.chain <> b.chain AND {DIST} <= 8 WHERE a.atom = 'CA' AND b.atom = 'CA' GROUP BY 1, 2, 3")
one("disulfide_bonds", "atoms", lambda d: st.disulfides(d, 9.0).withColumn("distance", r("distance")), f"WITH s AS (SELECT * FROM atoms WHERE residue = 'CYS' AND atom = 'SG') SELECT a.structure, a.id AS a, b.id AS b, round({DIST}, 6) AS distance FROM s a JOIN s b ON a.structure = b.structure AND a.id < b.id AND {DIST} <= 9")
one("flexible_residues", "atoms", lambda d: st.flexible(d).withColumn("b", r("b")), "WITH r AS (SELECT structure, chain, resseq, avg(bfactor) AS b FROM atoms GROUP BY 1, 2, 3), p AS (SELECT structure, quantile_cont(b, 0.9) AS p FROM r GROUP BY 1) SELECT r.structure, chain, resseq, round(b, 6) AS b FROM r JOIN p USING (structure) WHERE b >= p")
one("backbone_torsions", "SELECT p_partkey % 2 AS structure, 'A' AS chain, CAST(floor(p_partkey / 3) AS BIGINT) AS resseq, CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' ELSE 'C' END AS atom, CAST(p_partkey * 7 % 11 AS DOUBLE) AS x, CAST(p_partkey * 5 % 13 AS DOUBLE) AS y, CAST(p_partkey * 3 % 17 AS DOUBLE) AS z FROM part", lambda d: st.backbone_torsions(d).select("structure", "resseq", "phi", "psi"), None)
one("spot_neighbours", "spots", lambda d: st.degrees(d, "spot", 1.5), "SELECT a.spot, count(b.spot) AS neighbours FROM spots a LEFT JOIN spots b ON a.spot <> b.spot AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.5 GROUP BY a.spot")
one("spatial_autocorrelation", "spots", lambda d: st.moran(d, "spot", "value", 1.5).select("pairs", r("moran_i", 7)), "WITH m AS (SELECT avg(value) AS m, var_pop(value) AS v FROM spots) SELECT count(*) AS pairs, round(avg((a.value - m) * (b.value - m)) / max(v), 7) AS moran_i FROM spots a JOIN spots b ON a.spot < b.spot AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.5, m")
one("neighbour_labels", "spots", lambda d: st.neighbour_labels(d, "spot", "label", 1.5), "SELECT least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b, count(*) AS n FROM spots a JOIN spots b ON a.spot < b.spot AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 1.5 GROUP BY 1, 2")
SIZES = "SELECT cond AS grp, count(DISTINCT cell) AS cells FROM expression GROUP BY cond"
MEANS = f"SELECT gene, cond AS grp, sum(n) / max(cells) AS mean FROM expression JOIN ({SIZES}) ON cond = grp GROUP BY gene, cond"


def means(s, d):
    return cl.group_means(query(s, d, "SELECT cell, gene, n, cond AS grp FROM expression"), "gene", "grp", "n", query(s, d, SIZES))


QUERIES["cluster_means"] = lambda s, d: means(s, d).withColumn("mean", r("mean", 8))
ORACLE_SQL["cluster_means"] = duck(f"SELECT gene, grp, round(mean, 8) AS mean FROM ({MEANS})")
LR = "SELECT DISTINCT a.p_brand AS ligand, b.p_brand AS receptor FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 50 = 0"
QUERIES["cell_communication"] = lambda s, d: cl.communication(means(s, d), query(s, d, LR)).withColumn("score", r("score", 7))
ORACLE_SQL["cell_communication"] = duck(f"WITH m AS ({MEANS}) SELECT ligand, receptor, l.grp AS sender, q.grp AS receiver, round(sqrt(l.mean * q.mean), 7) AS score FROM ({LR}) p JOIN m l ON l.gene = ligand JOIN m q ON q.gene = receptor WHERE l.mean * q.mean > 0")
one("module_score", "expression", lambda d: cl.module_score(d, "cell", "gene", "n", ["Brand#1", "Brand#2", "Brand#3"]).withColumn("score", r("score")), "SELECT cell, round(coalesce(avg(n) FILTER (gene IN ('Brand#1', 'Brand#2', 'Brand#3')), 0) - coalesce(avg(n) FILTER (gene NOT IN ('Brand#1', 'Brand#2', 'Brand#3')), 0), 6) AS score FROM expression GROUP BY cell")
one("rna_velocity", "SELECT cell, gene, n AS s, cell % 7 + n % 5 AS u FROM expression", lambda d: cl.velocity(d, "gene", "s", "u").select("cell", "gene", r("velocity")), "SELECT cell, gene, round(u - s * sum(s * u) OVER w / sum(s * s) OVER w, 6) AS velocity FROM @ WINDOW w AS (PARTITION BY gene)")
one("rank_sum_test", "expression", lambda d: cl.rank_sum(d, "gene", "n", F.col("cond") == "R").select("gene", "n1", "n2", "u", r("z")), "WITH k AS (SELECT gene, n, cond, rank() OVER (PARTITION BY gene ORDER BY n) + (count(*) OVER (PARTITION BY gene, n) - 1) / 2 AS r, count(*) OVER (PARTITION BY gene, n) AS t FROM expression), s AS (SELECT gene, count_if(cond = 'R')::DOUBLE AS n1, count_if(cond <> 'R')::DOUBLE AS n2, sum(r) FILTER (cond = 'R') AS rs, sum(t * t - 1)::DOUBLE AS ties, count(*)::DOUBLE AS m FROM k GROUP BY gene) SELECT gene, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, rs - n1 * (n1 + 1) / 2 AS u, round((rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (m + 1 - ties / (m * (m - 1)))), 6) AS z FROM s WHERE n1 > 0 AND n2 > 0")
one("perturbation_synergy", "SELECT gene, cell % 2 = 0 AS pa, cell % 3 = 0 AS pb, n FROM expression", lambda d: cl.synergy(d, "gene", "pa", "pb", "n").withColumn("synergy", r("synergy")), "SELECT gene, round(avg(n) FILTER (pa AND pb) - avg(n) FILTER (pa AND NOT pb) - avg(n) FILTER (NOT pa AND pb) + avg(n) FILTER (NOT pa AND NOT pb), 6) AS synergy FROM @ GROUP BY gene HAVING count(*) FILTER (pa AND pb) > 0 AND count(*) FILTER (pa AND NOT pb) > 0 AND count(*) FILTER (NOT pa AND pb) > 0 AND count(*) FILTER (NOT pa AND NOT pb) > 0")
QUERIES["negative_binomial_test"] = lambda s, d: cl.negative_binomial_test(query(s, d, "SELECT * FROM counts"), query(s, d, "SELECT DISTINCT sample, CASE WHEN length(sample) = 8 THEN 0 ELSE 1 END AS grp FROM counts"), ab.size_factors(query(s, d, "SELECT * FROM counts"), "gene", "sample", "count"))
QUERIES["principal_components"] = lambda s, d: cl.principal_components(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", 3)
QUERIES["cell_clusters"] = lambda s, d: cl.clusters(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", 5).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
LOCATIONS = "SELECT doc_id, seq, doc_id % 3 AS kind, CAST(doc_id % 20 + 1 AS BIGINT) AS a, CAST(doc_id % 9 + 3 AS BIGINT) AS n FROM dna WHERE length(seq) >= 80"


def located(d):
    s = lambda c: c.cast("string")
    a, n = F.col("a"), F.col("n")
    join = F.concat(F.lit("join("), s(a), F.lit(".."), s(a + n), F.lit(","), s(a + n + 5), F.lit(".."), s(a + n + 9), F.lit(")"))
    text = F.when(F.col("kind") == 0, F.concat(s(a), F.lit(".."), s(a + n))).when(F.col("kind") == 1, F.concat(F.lit("complement("), s(a), F.lit("..>"), s(a + n), F.lit(")"))).otherwise(join)
    d = d.withColumn("loc", text)
    return d.select("doc_id", ft.extract(F.col("seq"), F.col("loc")).alias("part"), ft.bounds(F.col("loc"))["start"].alias("lo"), ft.bounds(F.col("loc"))["stop"].alias("hi"), ft.strand(F.col("loc")).alias("strand"), ft.holds(F.col("loc"), F.lit(12)).alias("at12"))


one("feature_sequences", LOCATIONS, located, "SELECT doc_id, CASE kind WHEN 0 THEN substr(seq, a, n + 1) WHEN 1 THEN reverse(translate(substr(seq, a, n + 1), 'ACGT', 'TGCA')) ELSE substr(seq, a, n + 1) || substr(seq, a + n + 5, 5) END AS part, CAST(a AS INT) AS lo, CAST(CASE kind WHEN 2 THEN a + n + 9 ELSE a + n END AS INT) AS hi, CASE kind WHEN 1 THEN '-' ELSE '+' END AS strand, (12 BETWEEN a AND a + n) OR (kind = 2 AND 12 BETWEEN a + n + 5 AND a + n + 9) AS at12 FROM @")
one("restriction_fragments", "SELECT doc_id, seq FROM dna WHERE length(seq) > 0", lambda d: ft.fragments(d, "doc_id", "seq", "MseI"), "WITH c AS (SELECT doc_id, i AS cut FROM (SELECT doc_id, seq, unnest(range(1, len(seq) - 2)) AS i FROM dna) WHERE substr(seq, i, 4) = 'TTAA'), e AS (SELECT doc_id, 0 AS start FROM dna WHERE len(seq) > 0 UNION ALL SELECT doc_id, cut FROM c) SELECT e.doc_id, CAST(row_number() OVER w - 1 AS INT) AS no, CAST(start AS INT) AS start, CAST(coalesce(lead(start) OVER w, len(seq)) - start AS INT) AS size FROM e JOIN dna d ON d.doc_id = e.doc_id WINDOW w AS (PARTITION BY e.doc_id ORDER BY start)")
