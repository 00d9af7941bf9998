"""Column functions on nucleotide and protein sequences, and on read qualities. All stay within generated or built-in code.

Sequences are upper-case strings. Positions are 1-based. Functions that look at every place of a sequence one by one
(k-mers, windows) work on short chunks of it, since a substring of a string column is found by walking from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The standard genetic code in the order TCAG, IUPAC complements, residue masses and scales.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC, COMPLEMENT = "ACGTURYKMSWBDHVN", "TGCAAYRMKSWVHDBN"
MASS_MONO = {"A": 71.03711, "R": 156.10111, "N": 114.04293, "D": 115.02694, "C": 103.00919, "E": 129.04259, "Q": 128.05858, "G": 57.02146, "H": 137.05891, "I": 113.08406, "L": 113.08406, "K": 128.09496, "M": 131.04049, "F": 147.06841, "P": 97.05276, "S": 87.03203, "T": 101.04768, "W": 186.07931, "Y": 163.06333, "V": 99.06841}
MASS_AVG = {"A": 71.0788, "R": 156.1875, "N": 114.1038, "D": 115.0886, "C": 103.1388, "E": 129.1155, "Q": 128.1307, "G": 57.0519, "H": 137.1411, "I": 113.1594, "L": 113.1594, "K": 128.1741, "M": 131.1926, "F": 147.1766, "P": 97.1167, "S": 87.0782, "T": 101.1051, "W": 186.2132, "Y": 163.1760, "V": 99.1326}
WATER = {"monoisotopic": 18.01524, "average": 18.01056}
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "E": -3.5, "Q": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
#: Places of a chunk when a sequence is taken apart.
CHUNK = 256


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among the letters."""
    return F.char_length(seq) - F.char_length(F.translate(seq, letters, ""))


def count_nucleotides(seq: Column) -> Column:
    """A, C, G, T, and N for all else."""
    parts = [count_of(seq, b).alias(b) for b in "ACGT"]
    return F.struct(*parts, (F.char_length(seq) - count_of(seq, "ACGT")).alias("N"))


def transcribe(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def gc_content(seq: Column) -> Column:
    """G, C and S over all letters that are surely strong or weak; 0 without any."""
    n = count_of(seq, "ACGTUSW")
    return F.when(n == 0, F.lit(0.0)).otherwise(count_of(seq, "GCS") / n)


def melting_temp(seq: Column, method: str = "wallace") -> Column:
    weak, strong = count_of(seq, "ATU"), count_of(seq, "GC")
    if method == "wallace":
        return (2 * weak + 4 * strong).cast("double")
    return F.when(weak + strong == 0, F.lit(0.0)).otherwise(F.lit(64.9).cast("double") + F.lit(41.0).cast("double") * (strong - F.lit(16.4).cast("double")) / (weak + strong))


def codons(seq: Column, frame: int = 1) -> Column:
    """Array of the whole codons from a frame on, found in one pass."""
    return F.regexp_extract_all(F.substring(seq, frame, 1 << 30), F.lit("(?s)..."), F.lit(0))


def amino_acid(codon: Column) -> Column:
    """One letter of a codon by its place in the order TCAG; X if a letter is none of these."""
    at = [F.instr(F.lit("TCAG"), F.substring(codon, k, 1)) for k in (1, 2, 3)]
    index = 16 * (at[0] - 1) + 4 * (at[1] - 1) + at[2]
    return F.when((at[0] == 0) | (at[1] == 0) | (at[2] == 0) | (F.char_length(codon) < 3), F.lit("X")).otherwise(F.substring(F.lit(CODE), index, F.lit(1)))


def translate_dna(seq: Column, frame: int = 1, stop_at_stop: bool = False) -> Column:
    protein = F.array_join(F.transform(codons(F.translate(seq, "U", "T"), frame), amino_acid), "")
    return F.substring_index(protein, "*", 1) if stop_at_stop else protein


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of equal length; an error otherwise."""
    n = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.when(F.char_length(a) == F.char_length(b), n).otherwise(F.raise_error(F.lit("sequences differ in length")))


def whole_frames(seq: Column) -> Column:
    """Array of (strand, frame, protein): the six whole-frame translations."""
    both = [("+", seq), ("-", reverse_complement(seq))]
    return F.array(*[F.struct(F.lit(s).alias("strand"), F.lit(f).alias("frame"), translate_dna(x, f).alias("protein")) for s, x in both for f in (1, 2, 3)])


def guide_efficiency(guide: Column, pam: Column) -> Column:
    """Score of a guide RNA from GC share, first and last bases and runs of four."""
    gc = gc_content(guide)
    score = F.lit(0.6).cast("double") * (1 - F.abs(gc - 0.5) / 0.5)
    score = score + F.when(guide.startswith("G"), 0.05).otherwise(0.0) + F.when(pam.endswith("GG") & guide.endswith("G"), 0.05).otherwise(0.0)
    score = score - F.when(guide.rlike("A{4}|C{4}|G{4}|T{4}"), 0.25).otherwise(0.0)
    return F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(1.0))


def weighted_sum(seq: Column, weights: dict[str, float]) -> Column:
    """Sum of a weight for each letter, from the letters' counts."""
    total = F.lit(0.0)
    for letter, w in weights.items():
        total = total + count_of(seq, letter) * F.lit(w).cast("double")
    return total


def protein_mass(seq: Column, kind: str = "monoisotopic") -> Column:
    return weighted_sum(seq, MASS_MONO if kind == "monoisotopic" else MASS_AVG) + F.lit(WATER[kind])


def extinction_coefficient(seq: Column) -> Column:
    return 1490 * count_of(seq, "Y") + 5500 * count_of(seq, "W") + 125 * count_of(seq, "C")


def gravy(seq: Column) -> Column:
    return F.when(F.char_length(seq) == 0, F.lit(0.0)).otherwise(weighted_sum(seq, HYDROPATHY) / F.char_length(seq))


def aliphatic_index(seq: Column) -> Column:
    n = F.char_length(seq)
    return F.when(n == 0, F.lit(0.0)).otherwise(100.0 * (count_of(seq, "A") + F.lit(2.9).cast("double") * count_of(seq, "V") + F.lit(3.9).cast("double") * count_of(seq, "IL")) / n)


# --- rows for each place ---------------------------------------------------------------------------------------------


def chunks(df: DataFrame, seq: str, overlap: int, size: int = CHUNK, spread: bool = False) -> DataFrame:
    """Rows (…, _at, _part): chunks of a sequence, each with `overlap` characters of the next; cut as bytes, in linear time.

    spread deals the chunks out anew, for few long sequences (a genome): one shuffle of the letters, so that no task holds
    a whole chromosome's work. Reads need none.
    """
    raw = F.col(seq).cast("binary")
    n = F.octet_length(raw)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1 - overlap), F.lit(size))).alias("_at")
    rows = df.where(n > overlap).select("*", at).withColumn("_part", F.substring(raw, F.col("_at") + 1, F.lit(size + overlap)).cast("string"))
    if spread:
        rows = rows.drop(seq)
        rows = rows.repartition(*[c for c in rows.columns if c != "_part"])
    return rows


def kmers(df: DataFrame, seq: str, k: int, spread: bool = False) -> DataFrame:
    """A row for each k-mer of each row's sequence: the columns of df without seq, pos (1-based), kmer."""
    parts = chunks(df, seq, k - 1, spread=spread)
    places = F.transform(F.sequence(F.lit(1), F.char_length("_part") - (k - 1)), lambda i: F.struct((F.col("_at") + i).alias("pos"), F.substring(F.col("_part"), i, F.lit(k)).alias("kmer")))
    keep = [c for c in df.columns if c != seq]
    return parts.select(*keep, F.inline(places))


def kmer_counts(df: DataFrame, seq: str, k: int, by: tuple[str, ...] = (), spread: bool = False) -> DataFrame:
    return kmers(df, seq, k, spread).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


def linguistic_complexity(df: DataFrame, seq: str, k: int, key: str) -> DataFrame:
    """Distinct k-mers over the most that could be: min(4**k, places)."""
    rows = kmers(df.select(key, seq), seq, k).groupBy(key).agg(F.count_distinct("kmer").alias("d"), F.count(F.lit(1)).alias("m"))
    return rows.select(key, (F.col("d") / F.least(F.lit(4**k), F.col("m"))).alias("complexity"))


def sequence_entropy(df: DataFrame, seq: str, k: int, key: str) -> DataFrame:
    """Shannon entropy, in bits, of each row's k-mers."""
    n = kmer_counts(df.select(key, seq), seq, k, (key,))
    total = n.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(key, (F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def windows(df: DataFrame, seq: str, width: int, step: int) -> DataFrame:
    """GC share of sliding windows: the columns of df without seq, start, stop (1-based, closed), gc."""
    raw = F.col(seq).cast("binary")
    at = F.explode(F.sequence(F.lit(1), F.octet_length(raw) - width + 1, F.lit(step))).alias("start")
    rows = df.where(F.octet_length(raw) >= width).select("*", at).withColumn("_w", F.substring(raw, F.col("start"), F.lit(width)).cast("string"))
    return rows.select(*[c for c in df.columns if c != seq], "start", (F.col("start") + width - 1).alias("stop"), gc_content(F.col("_w")).alias("gc"))


def gc_skew_minimum(df: DataFrame, seq: str, key: str) -> DataFrame:
    """The smallest running count of G less C (0 before the first base), and the first place at which it is reached."""
    parts = chunks(df.select(key, seq), seq, 0)
    one = lambda c: F.when(c == "G", 1).when(c == "C", -1).otherwise(0)
    step = F.aggregate(
        F.split("_part", ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("low"), F.lit(0).alias("at")),
        lambda a, c: F.struct((a["s"] + one(c)).alias("s"), (a["i"] + 1).alias("i"), F.least(a["low"], a["s"] + one(c)).alias("low"), F.when(a["s"] + one(c) < a["low"], a["i"] + 1).otherwise(a["at"]).alias("at")),
    )
    from pyspark.sql import Window

    rows = parts.select(key, "_at", step.alias("x"))
    before = F.coalesce(F.sum("x.s").over(Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select(key, (before + F.col("x.low")).alias("low"), (F.col("_at") + F.col("x.at")).alias("at"))
    best = rows.groupBy(key).agg(F.min(F.struct("low", "at")).alias("b"))
    return best.select(key, F.col("b.low").alias("min_skew"), F.col("b.at").alias("at"))


def find_sites(df: DataFrame, seq: str, pattern: str, width: int) -> DataFrame:
    """Each place (1-based) at which the sequence matches a pattern of fixed width; matches may overlap."""
    return kmers(df, seq, width).where(F.col("kmer").rlike(f"^(?:{pattern})$"))


# --- read qualities --------------------------------------------------------------------------------------------------


def phred_scores(quality: Column, offset: int = 33) -> Column:
    return F.transform(F.split(quality, ""), lambda c: F.ascii(c) - offset)


def phred_string(scores: Column, offset: int = 33) -> Column:
    return F.array_join(F.transform(scores, lambda s: F.char(s + offset)), "")


def mean_quality(scores: Column) -> Column:
    return F.when(F.size(scores) == 0, F.lit(0.0)).otherwise(F.aggregate(scores, F.lit(0), lambda a, x: a + x) / F.size(scores))


def quality_passes(scores: Column, min_mean: float = 20, min_base: float = 0, max_low_share: float = 1.0) -> Column:
    low = F.size(F.filter(scores, lambda s: s < min_base))
    return (mean_quality(scores) >= min_mean) & (low <= max_low_share * F.size(scores))


def trim_span(scores: Column, window: int = 4, threshold: float = 20) -> Column:
    """Struct (first, last), 1-based: from the first window whose mean reaches the threshold to the end of the last; null if none does."""
    sums = F.aggregate(scores, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    # One-element arrays hold what is computed once and looked at often.
    places = F.transform(F.array(sums), lambda t: F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - window)), lambda i: F.element_at(t, i + window) - F.element_at(t, i) >= threshold * window))
    spans = F.transform(places, lambda g: F.when(F.size(g) > 0, F.struct(F.array_min(g).alias("first"), (F.array_max(g) + (window - 1)).alias("last"))))
    return F.when(F.size(scores) >= window, F.element_at(spans, 1))


def adapter_start(seq: Column, adapter: str, min_overlap: int = 8, max_mismatches: int = 1) -> Column:
    """Where (1-based) a 3' adapter begins: the longest overlap of the read's end with the adapter's beginning that has few mismatches; null if none."""
    n = F.char_length(seq)
    lengths = F.sequence(F.least(n, F.lit(len(adapter))), F.lit(min_overlap), F.lit(-1))
    bad = lambda w: F.aggregate(F.zip_with(F.split(F.substring(seq, n - w + 1, w), ""), F.split(F.substring(F.lit(adapter), F.lit(1), w), ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    fits = F.filter(lengths, lambda w: bad(w) <= max_mismatches)
    return F.when((F.least(n, F.lit(len(adapter))) >= min_overlap) & (F.size(fits) > 0), n - F.element_at(fits, 1) + 1)


# --- compact variant codes -------------------------------------------------------------------------------------------


def encode_chromosome(chrom: Column) -> Column:
    """1-22 as such, X 23, Y 24, M or MT 25, anything else 0; a leading chr counts for nothing."""
    bare = F.upper(F.regexp_replace(chrom, "(?i)^chr", ""))
    number = F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(F.expr("null"))
    return F.coalesce(number, bare.try_cast("int"), F.lit(0))


def encode_base(base: Column) -> Column:
    at = F.instr(F.lit("ACGTN"), F.upper(base))
    return F.when((F.char_length(base) == 1) & (at > 0), at).otherwise(F.raise_error(F.lit("a base is one of A, C, G, T, N")))


def encode_identifier(identifier: Column) -> Column:
    """FNV-1a, 32 bits, over the identifier's characters."""
    return F.aggregate(F.split(identifier, ""), F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long"), F.lit(4294967296).cast("long")))


# --- charge, weight, primers -----------------------------------------------------------------------------------------

# Dissociation constants of side chains and ends, weights of nucleotides in a strand.
PK_POSITIVE = {"H": 6.04, "K": 10.54, "R": 12.48}
PK_NEGATIVE = {"D": 3.9, "E": 4.07, "C": 8.18, "Y": 10.46}
PK_FIRST, PK_LAST = 8.2, 3.65
NUCLEOTIDE_WEIGHT = {"A": 313.21, "C": 289.18, "G": 329.21, "T": 304.2}


def charge(counts: dict[str, Column], ph: Column) -> Column:
    """Net charge of a protein with these counts of charged residues."""
    up = lambda n, pk: n / (1 + F.pow(F.lit(10.0), ph - pk))
    down = lambda n, pk: n / (1 + F.pow(F.lit(10.0), pk - ph))
    total = up(F.lit(1.0), PK_FIRST) - down(F.lit(1.0), PK_LAST)
    for letter, pk in PK_POSITIVE.items():
        total = total + up(counts[letter], pk)
    for letter, pk in PK_NEGATIVE.items():
        total = total - down(counts[letter], pk)
    return total


def isoelectric_point(protein: Column, steps: int = 20) -> Column:
    """The pH at which the net charge is zero, by halving 0 to 14 so many times."""
    counts = F.struct(*[count_of(F.upper(protein), a).cast("double").alias(a) for a in (*PK_POSITIVE, *PK_NEGATIVE)])

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2
        positive = charge({a: state["n"][a] for a in (*PK_POSITIVE, *PK_NEGATIVE)}, mid) > 0
        return F.struct(F.when(positive, mid).otherwise(state["lo"]).alias("lo"), F.when(positive, state["hi"]).otherwise(mid).alias("hi"), state["n"].alias("n"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi"), counts.alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def instability_index(proteins: DataFrame, weights: DataFrame, key: str, protein: str) -> DataFrame:
    """Ten times the mean weight of neighbouring residues; weights (pair, weight) is the scale's table, at most 400 rows."""
    pairs = kmers(proteins.select(key, protein), protein, 2).join(F.broadcast(weights.select(F.col("pair").alias("kmer"), "weight")), "kmer")
    total = pairs.groupBy(key).agg(F.sum("weight").alias("_w"))
    return proteins.where(F.length(protein) >= 2).join(total, key, "left").select(key, (10.0 / F.length(protein) * F.coalesce("_w", F.lit(0.0))).alias("instability"))


def dna_weight(seq: Column) -> Column:
    """Of a single strand with a free 5' phosphate group left off."""
    return F.when(F.char_length(seq) == 0, F.lit(0.0)).otherwise(weighted_sum(seq, NUCLEOTIDE_WEIGHT) - F.lit(61.96))


def primer_dimer(a: Column, b: Column, overlap: int = 4) -> Column:
    """Whether the last bases of one primer pair with a place in the other."""
    ends = lambda x, y: F.contains(reverse_complement(y), F.substring(x, -overlap, overlap))
    return (F.char_length(a) >= overlap) & (F.char_length(b) >= overlap) & (ends(a, b) | ends(b, a))


def pcr_products(df: DataFrame, seq: str, forward: str, reverse: str, longest: int = 3000) -> DataFrame:
    """(columns of df without seq, start, stop, size): from each place of the forward primer to each later one of the reverse primer's complement."""
    back = "".join(dict(zip(IUPAC, COMPLEMENT))[c] for c in reversed(reverse))
    keep = [c for c in df.columns if c != seq]
    left = find_sites(df, seq, forward, len(forward)).select(*keep, F.col("pos").alias("start"))
    right = find_sites(df, seq, back, len(back)).select(*keep, (F.col("pos") + len(back) - 1).alias("stop"))
    found = left.join(right, keep).withColumn("size", F.col("stop") - F.col("start") + 1)
    return found.where((F.col("size") >= len(forward) + len(back)) & (F.col("size") <= longest))
