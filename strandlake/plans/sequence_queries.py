"""Queries of sequence and read-quality functions over the letters of documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.plans.views import duck, query, view

QUERIES, ORACLE_SQL = {}, {}


def scalar(name, columns, sql, source="SELECT doc_id, seq FROM dna"):
    """A projection of (doc_id, seq): what gives a dict of name -> column, and the SQL text of the same columns."""
    QUERIES[name] = lambda s, d: query(s, d, source).select("doc_id", *[c.alias(n) for n, c in columns(F.col("seq")).items()])
    ORACLE_SQL[name] = duck(f"SELECT doc_id, {sql} FROM ({source})")


def rows(name, operator, sql, source="dna"):
    QUERIES[name] = lambda s, d: operator(view(s, d, source) if " " not in source else query(s, d, source))
    ORACLE_SQL[name] = duck(sql)


N = "len(replace(seq, '{0}', ''))"


def n_of(x, column="seq"):
    return "+".join(f"(len({column}) - len(replace({column}, '{c}', '')))" for c in x)


GC = "CASE WHEN len({0}) = 0 THEN 0.0::DOUBLE ELSE len(regexp_replace({0}, '[AT]', '', 'g'))::DOUBLE / len({0}) END"
RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
AA = f"substr('{sq.CODE}', 16 * (instr('TCAG', substr({{s}}, 3 * i + {{f}}, 1)) - 1) + 4 * (instr('TCAG', substr({{s}}, 3 * i + {{f}} + 1, 1)) - 1) + instr('TCAG', substr({{s}}, 3 * i + {{f}} + 2, 1)), 1)"
PROTEIN = "array_to_string(list_transform(range(0, (len({s}) - {f} + 1) // 3), lambda i: " + AA + "), '')"
BOTH = f"SELECT doc_id, '+' AS strand, seq AS x FROM dna UNION ALL SELECT doc_id, '-' AS strand, {RC} AS x FROM dna"
prot = PROTEIN.format(s="seq", f=1)

scalar("count_nucleotides", lambda seq: {b: sq.count_nucleotides(seq)[b] for b in "ACGTN"}, ", ".join(f"{n_of(b)} AS \"{b}\"" for b in "ACGT") + ", 0 AS \"N\"")
scalar("transcribe_dna", lambda seq: {"rna": sq.transcribe(seq)}, "replace(seq, 'T', 'U') AS rna")
scalar("reverse_complement", lambda seq: {"rc": sq.reverse_complement(seq)}, f"{RC} AS rc")
scalar("gc_content", lambda seq: {"gc": F.round(sq.gc_content(seq), 9)}, f"round({GC.format('seq')}, 9) AS gc")
scalar("melting_temp", lambda seq: {"wallace": sq.melting_temp(seq), "basic": F.round(sq.melting_temp(seq, "basic"), 6)}, f"CAST(2 * ({n_of('AT')}) + 4 * ({n_of('GC')}) AS DOUBLE) AS wallace, round(CASE WHEN len(seq) = 0 THEN 0.0 ELSE 64.9::DOUBLE + 41.0::DOUBLE * (({n_of('GC')}) - 16.4::DOUBLE) / len(seq) END, 6) AS basic")
scalar("translate_dna", lambda seq: {"protein": sq.translate_dna(seq), "to_stop": sq.translate_dna(seq, stop_at_stop=True)}, f"{prot} AS protein, split_part({prot}, '*', 1) AS to_stop")
scalar("hamming_distance", lambda seq: {"d": sq.hamming(seq, F.reverse(seq))}, "CASE WHEN len(seq) = 0 THEN 0 ELSE hamming(seq, reverse(seq)) END AS d")
scalar("is_dna", lambda seq: {"ok": seq.rlike("^[ACGTN]*$")}, "regexp_full_match(seq, '[ACGTN]*') AS ok")
scalar("codon_count", lambda seq: {"n": F.size(sq.codons(seq)), "first": F.element_at(F.concat(sq.codons(seq), F.array(F.lit("-"))), 1)}, "len(seq) // 3 AS n, CASE WHEN len(seq) < 3 THEN '-' ELSE substr(seq, 1, 3) END AS first")
rows(
    "find_orfs", lambda d: d.select("doc_id", F.inline(sq.whole_frames(F.col("seq")))).where(F.length("protein") >= 30),
    "SELECT doc_id, strand, frame, protein FROM (" + " UNION ALL ".join(f"SELECT doc_id, strand, {f} AS frame, {PROTEIN.format(s='x', f=f)} AS protein FROM ({BOTH})" for f in (1, 2, 3)) + ") WHERE len(protein) >= 30",
)
rows("protein_search", lambda d: d.select("doc_id", F.inline(sq.whole_frames(F.col("seq")))).where(F.contains("protein", F.lit("HN"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "SELECT doc_id, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, {PROTEIN.format(s='x', f=f)} AS protein FROM ({BOTH})" for f in (1, 2, 3)) + ") WHERE contains(protein, 'HN') GROUP BY doc_id")
KMERS = "SELECT doc_id, i AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, len(seq) - {k} + 2)) AS i FROM dna)"
for name, k in (("letter_frequency", 1), ("dinucleotide_frequency", 2), ("trinucleotide_frequency", 3), ("kmer_frequency", 5)):
    rows(name, lambda d, k=k: sq.kmer_counts(d, "seq", k), f"SELECT kmer, count(*) AS n FROM ({KMERS.format(k=k)}) GROUP BY kmer")
rows("oligonucleotide_share", lambda d: sq.kmer_counts(d, "seq", 4).crossJoin(F.broadcast(sq.kmers(d, "seq", 4).agg(F.count(F.lit(1)).alias("t")))).select("kmer", F.round(F.col("n") / F.col("t"), 9).alias("share")), f"SELECT kmer, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ({KMERS.format(k=4)}) GROUP BY kmer")
rows("sequence_complexity", lambda d: sq.linguistic_complexity(d, "seq", 3, "doc_id").select("doc_id", F.round("complexity", 9).alias("complexity")), f"SELECT doc_id, round(count(DISTINCT kmer) / least(64, count(*)), 9) AS complexity FROM ({KMERS.format(k=3)}) GROUP BY doc_id")
rows("sequence_entropy", lambda d: sq.sequence_entropy(d, "seq", 1, "doc_id").select("doc_id", F.round("entropy", 6).alias("entropy")), f"SELECT doc_id, round(-sum(p * log2(p)), 6) + 0 AS entropy FROM (SELECT doc_id, kmer, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM ({KMERS.format(k=1)}) GROUP BY doc_id, kmer) GROUP BY doc_id")
rows("sliding_window_gc", lambda d: sq.windows(d, "seq", 50, 25).withColumn("gc", F.round("gc", 9)), f"SELECT doc_id, start, start + 49 AS stop, round({GC.format('w')}, 9) AS gc FROM (SELECT doc_id, start, substr(seq, start, 50) AS w FROM (SELECT doc_id, seq, unnest(range(1, len(seq) - 48, 25)) AS start FROM dna))")
SKEW = f"SELECT doc_id, 0 AS pos, 0 AS s FROM dna WHERE len(seq) > 0 UNION ALL SELECT doc_id, pos, sum(CASE kmer WHEN 'G' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM ({KMERS.format(k=1)})"
rows("minimum_skew", lambda d: sq.gc_skew_minimum(d, "seq", "doc_id"), f"SELECT doc_id, CAST(s AS BIGINT) AS min_skew, pos AS at FROM ({SKEW}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s, pos) = 1")
CODON = "SELECT substr(seq, 3 * i + 1, 3) AS codon FROM (SELECT seq, unnest(range(0, len(seq) // 3)) AS i FROM dna)"
rows("codon_usage", lambda d: d.select(F.explode(sq.codons(F.col("seq"))).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n")), f"SELECT codon, count(*) AS n FROM ({CODON}) GROUP BY codon")
AA_OF = AA.format(s="codon", f=1).replace("3 * i + ", "").replace("1 + 1", "2").replace("1 + 2", "3")


def codon_table(d):
    from pyspark.sql import Window

    n = d.select(F.explode(sq.codons(F.col("seq"))).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n")).withColumn("aa", sq.amino_acid(F.col("codon"))).where("aa <> '*'")
    w = Window.partitionBy("aa")
    return n.select("codon", "aa", "n", F.round(F.col("n") / F.sum("n").over(w), 9).alias("fraction"), F.round((F.col("n") + 0.5) / F.max(F.col("n") + 0.5).over(w), 9).alias("adaptiveness"))


rows("codon_usage_table", codon_table, f"SELECT codon, aa, n, round(n / sum(n) OVER (PARTITION BY aa), 9) AS fraction, round((n + 0.5) / max(n + 0.5) OVER (PARTITION BY aa), 9) AS adaptiveness FROM (SELECT codon, {AA_OF} AS aa, count(*) AS n FROM ({CODON}) GROUP BY codon) WHERE aa <> '*'")


def adaptation(d):
    """exp of the mean log weight of each document's sense codons; the weights come from all documents together."""
    weights = codon_table(d).select("codon", F.log("adaptiveness").alias("w"))  # 61 rows at most
    return d.select("doc_id", F.explode(sq.codons(F.col("seq"))).alias("codon")).join(F.broadcast(weights), "codon").groupBy("doc_id").agg(F.round(F.exp(F.avg("w")), 6).alias("cai"))


rows("codon_adaptation_index", adaptation, f"WITH t AS (SELECT codon, ln(round((n + 0.5) / max(n + 0.5) OVER (PARTITION BY aa), 9)) AS w FROM (SELECT codon, {AA_OF} AS aa, count(*) AS n FROM ({CODON}) GROUP BY codon) WHERE aa <> '*'), c AS (SELECT doc_id, substr(seq, 3 * i + 1, 3) AS codon FROM (SELECT doc_id, seq, unnest(range(0, len(seq) // 3)) AS i FROM dna)) SELECT doc_id, round(exp(avg(w)), 6) AS cai FROM c JOIN t USING (codon) GROUP BY doc_id")
rows("restriction_sites", lambda d: sq.find_sites(d, "seq", "GAATTC|GGATCC|AAGCTT|GATATC|AGCT.{2}", 6), f"SELECT doc_id, pos, kmer FROM ({KMERS.format(k=6)}) WHERE regexp_full_match(kmer, 'GAATTC|GGATCC|AAGCTT|GATATC|AGCT.{{2}}')")
rows("pam_sites", lambda d: sq.find_sites(d, "seq", ".{20}.GG", 23).select("doc_id", "pos", F.substring("kmer", 1, 20).alias("guide"), F.round(sq.guide_efficiency(F.substring("kmer", 1, 20), F.substring("kmer", 21, 3)), 9).alias("score")), f"SELECT doc_id, pos, g AS guide, round(least(greatest(0.6 * (1 - abs({GC.format('g')} - 0.5) / 0.5) + CASE WHEN starts_with(g, 'G') THEN 0.05 ELSE 0 END + CASE WHEN ends_with(g, 'G') THEN 0.05 ELSE 0 END - CASE WHEN regexp_matches(g, 'A{{4}}|C{{4}}|G{{4}}|T{{4}}') THEN 0.25 ELSE 0 END, 0), 1), 9) AS score FROM (SELECT doc_id, pos, kmer, substr(kmer, 1, 20) AS g FROM ({KMERS.format(k=23)})) WHERE regexp_full_match(kmer, '.{{20}}.GG')")
rows("motif_counts", lambda d: sq.kmers(d, "seq", 1).groupBy("pos").agg(*[F.count_if(F.col("kmer") == b).alias(b) for b in "ACGT"]), f"SELECT pos, " + ", ".join(f"CAST(count_if(kmer = '{b}') AS BIGINT) AS \"{b}\"" for b in "ACGT") + f" FROM ({KMERS.format(k=1).replace('FROM dna', 'FROM pieces')}) GROUP BY pos", "pieces")
PRO = f"SELECT doc_id, replace({prot}, '*', '') AS p FROM dna"
mass = "+".join(f"{w}::DOUBLE * ({n_of(a, 'p')})" for a, w in sq.MASS_MONO.items())
kd = "+".join(f"({w})::DOUBLE * ({n_of(a, 'p')})" for a, w in sq.HYDROPATHY.items())
QUERIES["protparam"] = lambda s, d: view(s, d, "dna").select("doc_id", F.translate(sq.translate_dna(F.col("seq")), "*", "").alias("p")).select("doc_id", F.round(sq.protein_mass(F.col("p")), 4).alias("mass"), sq.extinction_coefficient(F.col("p")).alias("extinction"), F.round(sq.gravy(F.col("p")), 6).alias("gravy"), F.round(sq.aliphatic_index(F.col("p")), 6).alias("aliphatic"))
ORACLE_SQL["protparam"] = duck(f"SELECT doc_id, round({mass} + 18.01524, 4) AS mass, 1490 * ({n_of('Y', 'p')}) + 5500 * ({n_of('W', 'p')}) + 125 * ({n_of('C', 'p')}) AS extinction, round(CASE WHEN len(p) = 0 THEN 0.0::DOUBLE ELSE ({kd}) / len(p) END, 6) AS gravy, round(CASE WHEN len(p) = 0 THEN 0.0::DOUBLE ELSE 100.0 * (({n_of('A', 'p')}) + 2.9::DOUBLE * ({n_of('V', 'p')}) + 3.9::DOUBLE * ({n_of('IL', 'p')})) / len(p) END, 6) AS aliphatic FROM ({PRO})")
rows("compact_variants", lambda v: v.select("id", sq.encode_chromosome(F.col("chrom")).alias("chrom"), "pos", sq.encode_identifier(F.col("id")).alias("code"), sq.encode_base(F.col("ref")).alias("ref"), sq.encode_base(F.col("alt")).alias("alt"), F.col("qual").isNotNull().alias("has_qual")), "SELECT id, CAST(replace(chrom, 'chr', '') AS INT) AS chrom, pos, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(id, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS code, instr('ACGTN', ref) AS ref, instr('ACGTN', alt) AS alt, qual IS NOT NULL AS has_qual FROM variants", "variants")
READS = "SELECT doc_id, seq, translate(seq, 'ACGT', 'I5+#') AS qual FROM reads"


def scores():
    return sq.phred_scores(F.col("qual"))


QUERIES["read_quality"] = lambda s, d: query(s, d, READS).where("length(seq) > 0").select("doc_id", F.round(sq.mean_quality(scores()), 6).alias("mean"), sq.quality_passes(scores(), 20, 10, 0.3).alias("ok"), (sq.phred_string(scores()) == F.col("qual")).alias("back"))
SCORE = "list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)"
ORACLE_SQL["read_quality"] = duck(f"SELECT doc_id, round(list_avg({SCORE}), 6) AS mean, list_avg({SCORE}) >= 20 AND len(list_filter({SCORE}, lambda x: x < 10)) <= 0.3::DOUBLE * len(qual) AS ok, true AS back FROM ({READS}) WHERE len(seq) > 0")
QUERIES["quality_trim"] = lambda s, d: query(s, d, READS).where("length(seq) > 0").select("doc_id", sq.trim_span(scores(), 4, 25).alias("t")).where("t is not null").select("doc_id", "t.first", "t.last")
ORACLE_SQL["quality_trim"] = duck(f"WITH r AS (SELECT doc_id, {SCORE} AS q FROM ({READS}) WHERE len(seq) >= 4), w AS (SELECT doc_id, i, list_sum(q[i:i+3]) AS s FROM (SELECT doc_id, q, unnest(range(1, len(q) - 2)) AS i FROM r)) SELECT doc_id, CAST(min(i) AS INT) AS first, CAST(max(i) + 3 AS INT) AS last FROM w WHERE s >= 100 GROUP BY doc_id")
QUERIES["adapter_trim"] = lambda s, d: query(s, d, READS).select("doc_id", sq.adapter_start(F.col("seq"), "ATTATTAATAAC", 4, 1).alias("at")).where("at is not null")
ORACLE_SQL["adapter_trim"] = duck(f"WITH w AS (SELECT doc_id, seq, unnest(range(4, least(len(seq), 12) + 1)) AS k FROM ({READS}) WHERE len(seq) >= 4) SELECT doc_id, CAST(min(len(seq) - k + 1) AS INT) AS at FROM w WHERE hamming(substr(seq, len(seq) - k + 1, k), substr('ATTATTAATAAC', 1, k)) <= 1 GROUP BY doc_id")
