"""Queries of hidden Markov models, ranked enrichment, couplings and gene signals, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import models as md
from strandlake.plans.views import duck, query

QUERIES, ORACLE_SQL = {}, {}
MODEL = md.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.3, 0.2, 0.2, 0.3], [0.2, 0.3, 0.3, 0.2]]))
DNA = "SELECT doc_id, seq FROM dna WHERE length(seq) > 0"
KMERS = "SELECT doc_id, i AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, len(seq) - {k} + 2)) AS i FROM dna)"


def one(name, source, operator, sql):
    QUERIES[name] = lambda s, d: operator(query(s, d, source))
    if sql:
        ORACLE_SQL[name] = duck(sql.replace("@", f"({source})"))


one("hmm_log_likelihood", DNA, lambda d: md.log_likelihood(d, "doc_id", "seq", MODEL), None)
one("hmm_posterior_segments", DNA, lambda d: md.segments(md.posterior_path(d, "doc_id", "seq", MODEL), "doc_id", "path"), None)
one("state_segments", "SELECT doc_id, translate(seq, 'ACGT', '0110') AS path FROM dna WHERE length(seq) > 0", lambda d: md.segments(d, "doc_id", "path"), "WITH x AS (SELECT doc_id, i, substr(path, i, 1) AS c FROM (SELECT doc_id, path, unnest(range(1, len(path) + 1)) AS i FROM @)), y AS (SELECT *, CASE WHEN lag(c) OVER w = c THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)), z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM y) SELECT doc_id, c AS state, CAST(min(i) AS INT) AS start, CAST(max(i) AS INT) AS stop FROM z GROUP BY doc_id, k, c")
RANKED, SETS = "SELECT p_partkey AS gene, p_retailprice - 1400 AS score FROM part", "SELECT p_brand AS term, p_partkey AS gene FROM part"
QUERIES["ranked_enrichment"] = lambda s, d: md.ranked_enrichment(query(s, d, RANKED), query(s, d, SETS)).withColumn("es", F.round("es", 7))
ORACLE_SQL["ranked_enrichment"] = f"WITH r AS (SELECT gene, score, row_number() OVER (ORDER BY score DESC, gene) AS p, count(*) OVER () AS n FROM ({RANKED})), t AS (SELECT term, r.gene, p, n, abs(score) AS w FROM r JOIN ({SETS}) s ON s.gene = r.gene), g AS (SELECT term, sum(w) AS t, count(*) AS size FROM t GROUP BY term), x AS (SELECT g.term, size, p, sum(CASE WHEN t.gene IS NOT NULL THEN t.w / g.t ELSE 0 END) OVER (PARTITION BY g.term ORDER BY r.p) - sum(CASE WHEN t.gene IS NULL THEN 1 / (r.n - size) ELSE 0 END) OVER (PARTITION BY g.term ORDER BY r.p) AS v FROM g CROSS JOIN (SELECT gene, p, n FROM r) r LEFT JOIN (SELECT term, gene, w FROM t) t ON t.term = g.term AND t.gene = r.gene) SELECT term, size, round(CASE WHEN max(v) >= -min(v) THEN max(v) ELSE min(v) END, 7) AS es FROM x GROUP BY term, size"
ALIGNED = "SELECT doc_id, seq FROM pieces"
one("column_coupling", ALIGNED, lambda d: md.column_coupling(d, "doc_id", "seq", 5).withColumn("mi", F.round("mi", 7)), "WITH x AS (SELECT doc_id, i, substr(seq, i, 1) AS c FROM (SELECT doc_id, seq, unnest(range(1, 61)) AS i FROM @)), n AS (SELECT a.i AS i, b.i AS j, a.c AS x, b.c AS y, count(*) AS n FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.i < b.i AND b.i - a.i <= 5 GROUP BY ALL), o AS (SELECT i, c, count(*) AS m FROM x GROUP BY 1, 2), t AS (SELECT count(*) AS t FROM @) SELECT n.i, n.j, round(sum(n / t * ln(n * t / (p.m * q.m))), 7) AS mi FROM n JOIN o p ON p.i = n.i AND p.c = x JOIN o q ON q.i = n.j AND q.c = y, t GROUP BY 1, 2")
one("start_codons", "SELECT doc_id, seq FROM dna", lambda d: md.start_codons(d, "doc_id", "seq"), f"SELECT doc_id, pos + 6 AS pos, substr(kmer, 4, 1) IN ('A', 'G') AS purine, substr(kmer, 10, 1) = 'G' AS g4 FROM ({KMERS.format(k=10)}) WHERE substr(kmer, 7, 3) = 'ATG'")
one("stop_codons", "SELECT doc_id, seq FROM dna", lambda d: md.stop_codons(d, "doc_id", "seq"), f"SELECT doc_id, pos, (pos - 1) % 3 + 1 AS frame, kmer AS codon FROM ({KMERS.format(k=3)}) WHERE kmer IN ('TAA', 'TAG', 'TGA')")
one("splice_sites", "SELECT doc_id, seq FROM dna", lambda d: md.splice_sites(d, "doc_id", "seq"), f"SELECT doc_id, pos, 'donor' AS kind, CASE WHEN regexp_matches(kmer, '^GT[AG]AGT') THEN 6 ELSE 2 END AS score FROM ({KMERS.format(k=8)}) WHERE starts_with(kmer, 'GT') UNION ALL SELECT doc_id, pos + 6, 'acceptor', CAST(len(regexp_replace(substr(kmer, 1, 6), '[AG]', '', 'g')) AS INT) FROM ({KMERS.format(k=8)}) WHERE ends_with(kmer, 'AG')")
