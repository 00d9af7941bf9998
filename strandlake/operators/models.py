"""Hidden Markov models trained over tables, ranked set enrichment, column couplings, and gene signals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.operators.kernels import viterbi
from strandlake.operators.running import running


@dataclass
class Hmm:
    """Probabilities: start of each state, moves between states, and each state's letters in the order of the alphabet."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    alphabet: str = "ACGT"

    def codes(self, text: str) -> np.ndarray:
        return np.array([self.alphabet.index(c) for c in text], int)

    def forward_backward(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """Posterior of each state at each place, expected moves, and the log likelihood; scaled, so long texts don't vanish."""
        x = self.codes(text)
        n, k = len(x), len(self.start)
        if not n:
            return np.zeros((0, k)), np.zeros((k, k)), 0.0
        e = self.emit[:, x].T
        f, b, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
        f[0] = self.start * e[0]
        for t in range(n):
            if t:
                f[t] = (f[t - 1] @ self.move) * e[t]
            scale[t] = f[t].sum() or 1e-300
            f[t] /= scale[t]
        for t in range(n - 2, -1, -1):
            b[t] = self.move @ (e[t + 1] * b[t + 1]) / scale[t + 1]
        moves = self.move * (f[:-1].T @ (e[1:] * b[1:] / scale[1:, None])) if n > 1 else np.zeros((k, k))
        return f * b, moves, float(np.log(scale).sum())

    def decode(self, text: str) -> str:
        with np.errstate(divide="ignore"):
            logs = [dict(zip(self.alphabet, np.maximum(np.log(row), -1e9), strict=True)) for row in self.emit]
            return viterbi(text, np.maximum(np.log(self.start), -1e9).tolist(), np.maximum(np.log(self.move), -1e9).tolist(), logs)


def log_likelihood(df: DataFrame, key: str, seq: str, model: Hmm) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "log_likelihood": [model.forward_backward(s)[2] for s in f[seq]]})

    return df.select(key, seq).mapInPandas(run, f"{key} {kind}, log_likelihood double")


def posterior_path(df: DataFrame, key: str, seq: str, model: Hmm) -> DataFrame:
    """The likeliest state of each place by itself, as digits."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "path": ["".join(map(str, model.forward_backward(s)[0].argmax(1))) for s in f[seq]]})

    return df.select(key, seq).mapInPandas(run, f"{key} {kind}, path string")


def baum_welch(df: DataFrame, seq: str, model: Hmm, rounds: int = 20, tolerance: float = 1e-4) -> tuple[Hmm, list[float]]:
    """Trains a model on all rows. Each task sums expected counts over its rows; a round brings as many numbers to the driver as the model has, for each task."""
    k, a = len(model.start), len(model.alphabet)
    likelihoods: list[float] = []
    for _ in range(rounds):
        now = model

        def count(frames, now=now):
            s, m, e, ll = np.zeros(k), np.zeros((k, k)), np.zeros((k, a)), 0.0
            for f in frames:
                for text in f[seq]:
                    g, moves, one = now.forward_backward(text)
                    if len(g):
                        s += g[0]
                        m += moves
                        np.add.at(e.T, now.codes(text), g)
                        ll += one
            yield pd.DataFrame({"i": range(k + k * k + k * a + 1), "v": np.concatenate([s, m.ravel(), e.ravel(), [ll]])})

        total = {r["i"]: r["v"] for r in df.select(seq).mapInPandas(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        v = np.array([total.get(i, 0.0) for i in range(k + k * k + k * a + 1)]) + 1e-12
        unit = lambda x: x / x.sum(-1, keepdims=True)
        model = Hmm(unit(v[:k]), unit(v[k : k + k * k].reshape(k, k)), unit(v[k + k * k : -1].reshape(k, a)), model.alphabet)
        likelihoods.append(float(v[-1]))
        if len(likelihoods) > 1 and abs(likelihoods[-1] - likelihoods[-2]) < tolerance * abs(likelihoods[-2]):
            break
    return model, likelihoods


def segments(df: DataFrame, key: str, path: str) -> DataFrame:
    """Runs of one letter of a path: key, state, start, stop (1-based, closed), found by a pattern in one pass."""
    runs = F.regexp_extract_all(F.col(path), F.lit(r"((.)\2*)"), F.lit(1))
    ends = F.aggregate(runs, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    rows = df.select(key, runs.alias("_r"), ends.alias("_e")).select(key, "_e", F.posexplode("_r").alias("_i", "_x"))
    return rows.select(key, F.substring("_x", 1, 1).alias("state"), (F.element_at("_e", F.col("_i") + 1) + 1).alias("start"), F.element_at("_e", F.col("_i") + 2).alias("stop"))


def ranked_enrichment(ranked: DataFrame, sets: DataFrame, gene: str = "gene", score: str = "score") -> DataFrame:
    """Enrichment score of each set over genes by falling score: the largest departure of hits (weighted by score) from misses.

    Between two members the running sum only falls, so it is looked at just before and at each member; rows are the sets' members, not sets times genes.
    """
    order = F.row_number().over(Window.orderBy(F.desc(score), gene))
    places = ranked.select(gene, score, order.alias("_p"))  # one sort of all genes
    n = F.broadcast(ranked.agg(F.count(F.lit(1)).alias("_n")))
    m = sets.select("term", gene).distinct().join(places, gene).withColumn("_w", F.abs(score))
    t = m.groupBy("term").agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("size"))
    m = running(m.join(t, "term").crossJoin(n), ["term"], "_p", ["_p"], F.col("_w"), "sum", "_hit")
    m = running(m, ["term"], "_p", ["_p"], F.lit(1), "sum", "_k")
    miss = (F.col("_p") - F.col("_k")) / (F.col("_n") - F.col("size"))
    at, before = F.col("_hit") / F.col("_t") - miss, (F.col("_hit") - F.col("_w")) / F.col("_t") - miss
    s = m.where("size < _n").groupBy("term", "size").agg(F.max(at).alias("_up"), F.min(before).alias("_down"))
    return s.select("term", "size", F.when(F.col("_up") >= -F.col("_down"), F.col("_up")).otherwise(F.col("_down")).alias("es"))


def column_coupling(df: DataFrame, key: str, seq: str, near: int | None = None) -> DataFrame:
    """Mutual information (natural) of pairs of columns of aligned sequences: i < j, at most `near` apart."""
    x = sq.kmers(df.select(key, seq), seq, 1)
    a, b = x.select(key, F.col("pos").alias("i"), F.col("kmer").alias("x")), x.select(key, F.col("pos").alias("j"), F.col("kmer").alias("y"))
    on = (F.col("i") < F.col("j")) if near is None else (F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= near)
    n = a.join(b, key).where(on).groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    one = x.groupBy("pos", "kmer").agg(F.count(F.lit(1)).alias("m"))
    n = n.join(one.toDF("i", "x", "mx"), ["i", "x"]).join(one.toDF("j", "y", "my"), ["j", "y"])
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))
    return n.crossJoin(total).groupBy("i", "j").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("mx") * F.col("my")))).alias("mi"))


def start_codons(df: DataFrame, key: str, seq: str) -> DataFrame:
    """ATG with six letters before and one behind: pos (of A), and whether -3 is a purine and +4 a G."""
    k = sq.kmers(df.select(key, seq), seq, 10).where(F.substring("kmer", 7, 3) == "ATG")
    return k.select(key, (F.col("pos") + 6).alias("pos"), F.substring("kmer", 4, 1).isin("A", "G").alias("purine"), (F.substring("kmer", 10, 1) == "G").alias("g4"))


def stop_codons(df: DataFrame, key: str, seq: str) -> DataFrame:
    k = sq.kmers(df.select(key, seq), seq, 3).where(F.col("kmer").isin("TAA", "TAG", "TGA"))
    return k.select(key, "pos", ((F.col("pos") - 1) % 3 + 1).alias("frame"), F.col("kmer").alias("codon"))


def splice_sites(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Donors (GT, with GT[AG]AGT as strong) and acceptors (AG behind six letters, with its pyrimidines counted)."""
    k = sq.kmers(df.select(key, seq), seq, 8)
    donor = k.where(F.col("kmer").startswith("GT")).select(key, "pos", F.lit("donor").alias("kind"), F.when(F.col("kmer").rlike("^GT[AG]AGT"), 6).otherwise(2).alias("score"))
    acceptor = k.where(F.col("kmer").endswith("AG")).select(key, (F.col("pos") + 6).alias("pos"), F.lit("acceptor").alias("kind"), sq.count_of(F.substring("kmer", 1, 6), "CT").alias("score"))
    return donor.unionByName(acceptor)
