"""Queries over count matrices, peptides, cells, gene sets and long reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.operators import abundance as ab
from strandlake.operators import repertoire as rp
from strandlake.plans.repertoire_queries import DIVERSITY
from strandlake.plans.views import duck, query

QUERIES, ORACLE_SQL = {}, {}


def one(name, source, operator, sql):
    text = source if " " in source else f"SELECT * FROM {source}"
    QUERIES[name] = lambda s, d: operator(query(s, d, text))
    if sql:
        ORACLE_SQL[name] = duck(sql.replace("@", f"({text})"))


def r(column, digits=8):
    return F.round(column, digits).alias(column)


GEO = "SELECT gene, avg(ln(count)) AS g FROM counts WHERE count > 0 GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT sample) FROM counts)"
FACTORS = f"SELECT sample, exp(median(ln(count) - g)) AS f FROM counts JOIN ({GEO}) USING (gene) WHERE count > 0 GROUP BY sample"
one("filter_low_counts", "counts", lambda d: ab.filter_low_counts(d, "gene", "count", 600, 20, 24), "SELECT * FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY gene HAVING sum(count) >= 600 AND count_if(count >= 20) >= 24)")
one("size_factors", "counts", lambda d: ab.size_factors(d, "gene", "sample", "count").select("sample", r("size_factor")), f"SELECT sample, round(f, 8) AS size_factor FROM ({FACTORS})")
one("normalized_counts", "counts", lambda d: ab.normalize(d, ab.size_factors(d, "gene", "sample", "count"), "sample", "count").select("gene", "sample", r("normalized", 6)), f"SELECT gene, sample, round(count / f, 6) AS normalized FROM counts JOIN ({FACTORS}) USING (sample)")
one("counts_per_million", "counts", lambda d: ab.counts_per_million(d, "sample", "count").select("gene", "sample", r("cpm", 5), r("log_cpm", 7)), "SELECT gene, sample, round(count * 1e6 / sum(count) OVER w, 5) AS cpm, round(log2((count + 0.5::DOUBLE) / (sum(count) OVER w + 1) * 1e6), 7) AS log_cpm FROM counts WINDOW w AS (PARTITION BY sample)")
one("vst", "counts", lambda d: d.select("gene", "sample", F.round(ab.vst(F.col("count").cast("double"), F.lit(0.1)), 7).alias("v")), "SELECT gene, sample, round(2 / sqrt(0.1::DOUBLE) * asinh(sqrt(0.1::DOUBLE * count)) / ln(2), 7) AS v FROM counts")
GROUPED = "SELECT gene, sample, count, CASE WHEN length(sample) = 8 THEN 'a' ELSE 'b' END AS grp FROM counts"
WELCH = "WITH s AS (SELECT gene, count(*) FILTER (grp = 'a') AS na, count(*) FILTER (grp = 'b') AS nb, avg(count) FILTER (grp = 'a') AS ma, avg(count) FILTER (grp = 'b') AS mb, var_samp(count) FILTER (grp = 'a') AS va, var_samp(count) FILTER (grp = 'b') AS vb FROM @ GROUP BY gene)"
one("fold_change", GROUPED, lambda d: ab.log_fold(d, "gene", "grp", "count", "a", "b").select("gene", r("log2fc", 7), r("t", 6), r("df", 4)), WELCH + " SELECT gene, round(log2((mb + 1) / (ma + 1)), 7) AS log2fc, round((mb - ma) / sqrt(va / na + vb / nb), 6) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df FROM s WHERE na > 1 AND nb > 1")
one("differential_expression", GROUPED, lambda d: ab.differential(d, "gene", "grp", "count", "a", "b").select("gene", "log2fc", "pvalue", "padj"), None)
one("remove_batch_effect", GROUPED, lambda d: ab.batch_residual(d, "gene", "grp", "count").select("gene", "sample", r("corrected", 6)), "SELECT gene, sample, round(count - avg(count) OVER (PARTITION BY gene, grp) + avg(count) OVER (PARTITION BY gene), 6) AS corrected FROM @")
one("tmm_values", "counts", lambda d: ab.tmm_pairs(d, "gene", "sample", "count", "NATION_3").select("gene", "sample", r("m", 7), r("a", 7)), "WITH p AS (SELECT gene, sample, count / sum(count) OVER (PARTITION BY sample) AS p FROM counts WHERE count > 0) SELECT p.gene, p.sample, round(log2(p.p / q.p), 7) + 0 AS m, round(log2(p.p * q.p) / 2, 7) AS a FROM p JOIN p q ON p.gene = q.gene AND q.sample = 'NATION_3'")
one("clr_transform", "counts", lambda d: ab.centred_log_ratio(d, "sample", "count").select("gene", "sample", r("clr", 7)), "SELECT gene, sample, round(ln(count + 0.5::DOUBLE) - avg(ln(count + 0.5::DOUBLE)) OVER (PARTITION BY sample), 7) AS clr FROM counts")
one("bray_curtis", "counts", lambda d: ab.bray_curtis(d, "gene", "sample", "count").withColumn("distance", r("distance")), "WITH t AS (SELECT sample, sum(count) AS t FROM counts GROUP BY 1), w AS (SELECT x.sample AS a, y.sample AS b, sum(least(x.count, y.count)) AS w FROM counts x JOIN counts y ON x.gene = y.gene AND x.sample < y.sample GROUP BY 1, 2) SELECT x.sample AS a, y.sample AS b, round(1 - 2 * coalesce(w, 0) / (x.t + y.t), 8) AS distance FROM t x JOIN t y ON x.sample < y.sample LEFT JOIN w ON w.a = x.sample AND w.b = y.sample")
one("community_diversity", "counts", lambda d: rp.diversity_of_counts(d, "count", ["sample"]).select("sample", "total", "richness", r("shannon", 6), r("simpson", 9), r("inverse_simpson", 5)), DIVERSITY.format(by="sample", n="SELECT sample, gene, count AS n FROM counts"))
KMERS = "SELECT doc_id, i AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, len(seq) - {k} + 2)) AS i FROM dna)"


def classify(d):
    reads = sq.kmers(d, "seq", 9)
    database = sq.kmers(d, "seq", 9).groupBy("kmer").agg(F.min(F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string"))).alias("taxon"))
    return ab.kmer_votes(reads, database, "doc_id")


one("kmer_classify", "dna", classify, f"WITH b AS (SELECT kmer, min('t' || doc_id % 7) AS taxon FROM ({KMERS.format(k=9)}) GROUP BY kmer), q AS (SELECT doc_id, kmer FROM ({KMERS.format(k=9)})), v AS (SELECT doc_id, taxon, count(*) AS n FROM q JOIN b USING (kmer) GROUP BY 1, 2), w AS (SELECT doc_id, taxon, n FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, taxon) = 1) SELECT q.doc_id, coalesce(taxon, 'unclassified') AS taxon, coalesce(n, 0) AS votes FROM (SELECT DISTINCT doc_id FROM q) q LEFT JOIN w USING (doc_id)")
one("pathway_totals", "SELECT gene, count FROM counts", lambda d: ab.pathway_totals(d, d.select("gene", F.concat(F.lit("p"), F.substring("gene", 7, 1)).alias("pathway")).distinct(), "gene", "count"), "SELECT 'p' || substr(gene, 7, 1) AS pathway, CAST(sum(count) AS BIGINT) AS abundance FROM counts GROUP BY 1")
one("strain_haplotypes", "SELECT user_id, pos % 40 AS pos, ref FROM variants", lambda d: ab.haplotypes(d, "user_id", "pos", "ref"), "SELECT user_id, string_agg(pos || ':' || ref, '|' ORDER BY pos, ref) AS haplotype FROM (SELECT DISTINCT user_id, pos, ref FROM @) GROUP BY user_id")
LINEAGES = "SELECT r_name || ';' || n_name || '|' || r_name || ';' || substring(n_name, 1, 3) || '|' || r_name || ';X' AS votes, n_nationkey AS k, r_name AS want FROM nation JOIN region ON n_regionkey = r_regionkey"
one("lowest_common_lineage", LINEAGES, lambda d: d.select("k", ab.lowest_common(F.col("votes")).alias("lineage")), "SELECT k, want AS lineage FROM @")
one("protein_top3", "peptides", lambda d: ab.top_sum_ranked(d, ["protein", "sample"], "intensity").select("protein", "sample", r("top", 2)), "SELECT protein, sample, round(sum(intensity), 2) AS top FROM (SELECT protein, sample, intensity FROM peptides QUALIFY row_number() OVER (PARTITION BY protein, sample ORDER BY intensity DESC) <= 3) GROUP BY 1, 2")
one("peptide_cv", "peptides", lambda d: ab.coefficient_of_variation(d, ["protein"], "intensity").select("protein", r("mean", 2), r("cv", 6)), "SELECT protein, round(avg(intensity), 2) AS mean, round(stddev_samp(intensity) / avg(intensity), 6) AS cv FROM peptides GROUP BY protein")
one("median_deviation", "peptides", lambda d: ab.median_deviation(d, ["protein"], "intensity").select("protein", r("median", 3), r("mad", 3)), "SELECT protein, round(median(intensity), 3) AS median, round(mad(intensity), 3) AS mad FROM peptides GROUP BY protein")
QUERIES["adduct_match"] = lambda s, d: ab.band_join(query(s, d, "SELECT DISTINCT p_partkey, p_retailprice AS x FROM part"), query(s, d, "SELECT DISTINCT s_suppkey, 900 + CAST(s_suppkey AS DOUBLE) * 9 AS y FROM supplier"), "x", "y", 200)
ORACLE_SQL["adduct_match"] = "SELECT p_partkey, p_retailprice AS x, s_suppkey, 900 + CAST(s_suppkey AS DOUBLE) * 9 AS y FROM part JOIN supplier ON abs(p_retailprice - (900 + CAST(s_suppkey AS DOUBLE) * 9)) <= (900 + CAST(s_suppkey AS DOUBLE) * 9) * 200 / 1e6"
PROTEIN = "SELECT doc_id, seq AS p FROM (SELECT doc_id, translate(seq, 'ACGT', 'NSTP') AS seq FROM dna)"
one("sequon_sites", PROTEIN, lambda d: d.where("length(p) > 2").select("doc_id", F.size(ab.sequon_sites(F.col("p"))).cast("long").alias("n")), "SELECT doc_id, CAST(count_if(regexp_full_match(substr(p, i, 3), 'N[^P][ST]')) AS BIGINT) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) - 1)) AS i FROM @ WHERE len(p) > 2) GROUP BY doc_id")
CELLS = "SELECT l_orderkey AS cell, p_brand AS gene, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand"
one("cell_metrics", CELLS, lambda d: ab.cell_metrics(d, "cell", "gene", "n", F.col("gene").endswith("1")).select("cell", "total", "features", r("mito_share")), "SELECT cell, CAST(sum(n) AS BIGINT) AS total, count(*) AS features, round(sum(CASE WHEN ends_with(gene, '1') THEN n ELSE 0 END) / sum(n), 8) AS mito_share FROM @ GROUP BY cell")
one("log_normalize", CELLS, lambda d: ab.log_normalize(d, "cell", "n").select("cell", "gene", r("value", 7)), "SELECT cell, gene, round(ln(1 + n / sum(n) OVER (PARTITION BY cell) * 10000), 7) AS value FROM @")
one("variable_features", CELLS, lambda d: ab.variable_features(d, "gene", "n", 20000, 10).select("gene", r("mean", 6), r("variance", 5)), "SELECT gene, round(m, 6) AS mean, round(q - m * m, 5) AS variance FROM (SELECT gene, sum(n) / 20000 AS m, sum(n * n) / 20000 AS q FROM @ GROUP BY gene) ORDER BY (q - m * m) / m DESC, gene LIMIT 10")
QUERIES["pseudobulk"] = lambda s, d: ab.pseudobulk(query(s, d, CELLS), query(s, d, "SELECT o_orderkey AS cell, o_orderpriority AS label FROM orders"), "cell", "gene", "n")
ORACLE_SQL["pseudobulk"] = duck(f"SELECT o_orderpriority AS label, gene, CAST(sum(n) AS BIGINT) AS n FROM ({CELLS}) JOIN orders ON o_orderkey = cell GROUP BY 1, 2")
one("set_overlap", "SELECT p_type AS term, CAST(p_size AS STRING) AS gene FROM part", ab.set_overlap, "WITH s AS (SELECT DISTINCT term, gene FROM @), n AS (SELECT term, count(*) AS n FROM s GROUP BY 1) SELECT x.term AS a, y.term AS b, count(*) AS m, count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)) AS jaccard FROM s x JOIN s y ON x.gene = y.gene AND x.term < y.term JOIN n nx ON nx.term = x.term JOIN n ny ON ny.term = y.term GROUP BY 1, 2")
SETS, HIT, ALL = "SELECT DISTINCT p_type AS term, CAST(p_size AS STRING) AS gene FROM part", "SELECT DISTINCT CAST(p_size AS STRING) AS gene FROM part WHERE p_size % 3 = 0", "SELECT DISTINCT CAST(p_size AS STRING) AS gene FROM part"
QUERIES["over_representation"] = lambda s, d: ab.over_representation(query(s, d, SETS), query(s, d, HIT), query(s, d, ALL)).select("term", "n_set", "overlap", "n_query", "n_universe", r("odds_ratio", 7))
ORACLE_SQL["over_representation"] = f"WITH s AS ({SETS}), q AS ({HIT}), u AS ({ALL}), x AS (SELECT term, count(*) AS n_set, CAST(count_if(gene IN (SELECT gene FROM q)) AS BIGINT) AS overlap, (SELECT count(*) FROM q) AS n_query, (SELECT count(*) FROM u) AS n_universe FROM s GROUP BY term) SELECT *, round(((overlap + 0.5) * (n_universe - n_set - n_query + overlap + 0.5))::DOUBLE / ((n_set - overlap + 0.5) * (n_query - overlap + 0.5))::DOUBLE, 7) AS odds_ratio FROM x"
SITES = "SELECT chrom, pos % 500 AS site, user_id % 5 AS m, event_id % 3 AS u FROM variants"
one("methylation_levels", SITES, lambda d: ab.methylation_levels(d, ["chrom", "site"], "m", "u", 3).withColumn("level", r("level")), "SELECT chrom, site, CAST(sum(m) AS BIGINT) AS m, CAST(sum(u) AS BIGINT) AS u, round(sum(m) / (sum(m) + sum(u)), 8) AS level FROM @ GROUP BY 1, 2 HAVING sum(m) + sum(u) >= 3")
one("read_n50", "SELECT lang, length(text) AS len FROM documents", lambda d: ab.n50(d, "len", ["lang"]), "WITH c AS (SELECT lang, len, sum(len) OVER (PARTITION BY lang ORDER BY len DESC RANGE UNBOUNDED PRECEDING) AS c, sum(len) OVER (PARTITION BY lang) AS t FROM @) SELECT lang, max(len) AS n50 FROM c WHERE c * 2 >= t GROUP BY lang")
one("read_contacts", "SELECT l_orderkey AS read, l_suppkey % 30 AS place FROM lineitem", lambda d: ab.contacts(d, "read", "place"), "WITH x AS (SELECT DISTINCT read, place FROM @) SELECT a.place AS a, b.place AS b, count(*) AS n FROM x a JOIN x b ON a.read = b.read AND a.place < b.place GROUP BY 1, 2")
one("minimizer_index", "dna", lambda d: ab.minimizers(sq.kmers(d, "seq", 7), "doc_id", 5), None)
CALLS = "SELECT event_id, chrom, pos FROM variants"
QUERIES["nearest_gene"] = lambda s, d: ab.nearest_gene(query(s, d, CALLS), query(s, d, "SELECT * FROM genes"), "event_id").select("event_id", "distance")
ORACLE_SQL["nearest_gene"] = duck(f"SELECT c.event_id, coalesce(min(greatest(0, g.start + 1 - c.pos, c.pos - g.stop)), -1) AS distance FROM ({CALLS}) c LEFT JOIN genes g ON g.chrom = c.chrom GROUP BY c.event_id")
