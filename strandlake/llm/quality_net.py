"""A byte-level convolutional network for document quality, trained and applied in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. In a chunk each byte becomes a learned vector;
learned filters, as wide as WIDTH bytes, slide over them; each filter's largest response in the chunk is kept. A second
layer turns the kept responses of a chunk into features, the largest of each feature over all chunks is kept, and a
last layer gives one probability. Training sees all chunks of its texts as well; only those that hold a feature's largest
value have a gradient. Long texts are not searched for these each time they are drawn (SEARCH_BYTES). Filters are applied as products with views of the byte vectors: starting at bytes
0, STEP, 2 * STEP ... below WIDTH, rows of WIDTH bytes lie one behind the other, so nothing is copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import python_ready, table, whole_text

CHUNK, OVERLAP = 256, 32
DIM, WIDTH, STEP, FILTERS, FEATURES = 4, 8, 2, 24, 16
#: The most labelled rows that training uses of each class, and the most bytes of all their texts. Rows are left out whole.
TRAIN_ROWS, TRAIN_BYTES = 1200, 64 << 20
#: About so many bytes of texts are searched for leading chunks in a training, besides each text's first search. If drawing
#: them takes more, whole texts are searched every k-th time they are drawn, and their last leading chunks serve in between.
SEARCH_BYTES = 256 << 20


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of n bytes begin; an empty text has one, empty chunk."""
    return np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)


def chunks_of(raw: bytes, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chunks, filled up with zeros, and the share of each that is filled."""
    at = chunk_starts(len(raw)) if at is None else at
    data = np.frombuffer(raw[at[0] : at[-1] + CHUNK] + bytes(CHUNK), np.uint8)
    size = np.minimum(CHUNK, len(raw) - at)
    out = data[(at - at[0])[:, None] + np.arange(CHUNK)]
    out[np.arange(CHUNK) >= size[:, None]] = 0
    return out, (size / CHUNK).astype(np.float32)


class Net:
    NAMES = ("embed", "filters", "bias", "second", "bias2", "last", "bias3")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(f)
        self.embed[0] = 0
        self.filters = r.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(f)
        self.bias = np.zeros(FILTERS, f)
        self.second = r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS + 1, FEATURES)).astype(f)
        self.bias2 = np.full(FEATURES, 0.1, f)
        self.last = r.normal(0, 0.3, FEATURES).astype(f)
        self.bias3 = np.zeros(1, f)

    def responses(self, chunks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each first byte: the byte vectors as rows of WIDTH bytes, and the filters' responses to them."""
        e = self.embed[chunks].reshape(len(chunks), CHUNK * DIM)
        for start in range(0, WIDTH, STEP):
            rows = (CHUNK - start) // WIDTH
            x = np.ascontiguousarray(e[:, start * DIM : (start + rows * WIDTH) * DIM]).reshape(-1, WIDTH * DIM)
            yield start, x, (x @ self.filters).reshape(len(chunks), rows, FILTERS)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        out = np.full((len(chunks), FILTERS), -np.inf, self.filters.dtype)
        for _, _, y in self.responses(chunks):
            np.maximum(out, y.max(1), out=out)
        return np.maximum(out + self.bias, 0)

    def features(self, chunks: np.ndarray, fill: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([self.pooled(chunks), fill[:, None]], 1) @ self.second + self.bias2, 0)

    def probability(self, top: np.ndarray) -> np.ndarray:
        """Of features that are already the largest over a text's chunks."""
        return 1 / (1 + np.exp(-np.clip(top.astype(np.float64) @ self.last.astype(np.float64) + float(self.bias3[0]), -60, 60)))

    def scores(self, texts: list[str], at_once: int = 512) -> np.ndarray:
        """Probability that each text is of good quality, from all its chunks, at_once of them at a time."""
        top = np.zeros((len(texts), FEATURES), np.float32)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def settle():
            nonlocal held, n
            if held:
                owner = np.concatenate([h[2] for h in held])
                np.maximum.at(top, owner, self.features(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))
            held, n = [], 0

        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "replace")
            starts = chunk_starts(len(raw))
            for k in range(0, len(starts), at_once):
                c, fill = chunks_of(raw, starts[k : k + at_once])
                held.append((c, fill, np.full(len(c), i)))
                n += len(c)
                if n >= at_once:
                    settle()
        settle()
        return self.probability(top)

    def leading(self, raw: bytes, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Of a text's chunks, those that hold the largest value of a feature: at most FEATURES, in their order."""
        starts = chunk_starts(len(raw))
        if len(starts) <= FEATURES:
            return chunks_of(raw, starts)
        best, where = np.full(FEATURES, -np.inf), np.zeros(FEATURES, np.int64)
        for k in range(0, len(starts), at_once):
            f = self.features(*chunks_of(raw, starts[k : k + at_once]))
            top = f.argmax(0)
            value = f[top, np.arange(FEATURES)]
            best, where = np.where(value > best, value, best), np.where(value > best, top + k, where)
        return chunks_of(raw, starts[np.unique(where)])

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = 450, batch: int = 32, rate: float = 6e-3, seed: int = 11, search_bytes: int = SEARCH_BYTES) -> Net:
        """Adam on the log loss; classes weigh the same. Gradients follow the largest responses back, of long texts those of their last search."""
        r = np.random.default_rng(seed)
        state = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in self.NAMES}
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        order = np.concatenate([r.permutation(len(texts)) for _ in range(-(-steps * batch // len(texts)))])
        long = np.array([len(t) if len(chunk_starts(len(t))) > FEATURES else 0 for t in texts], np.int64)
        every = max(1, -(-int(long[order[: steps * batch]].sum()) // search_bytes))
        drawn, led = np.zeros(len(texts), np.int64), {}

        def lead(k: int) -> tuple[np.ndarray, np.ndarray]:
            drawn[k] += 1
            if every == 1 or not long[k]:
                return self.leading(texts[k])
            if (drawn[k] - 1) % every == 0:
                led[k] = self.leading(texts[k])
            return led[k]

        for step in range(1, steps + 1):
            pick = order[(step - 1) * batch : step * batch]
            grads = self.gradients([lead(k) for k in pick], labels[pick], weight[pick])
            lr = rate * (1 - 0.95 * step / steps)
            for k, g in grads.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(self, k)[...] -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.embed[0] = 0
        return self

    def gradients(self, samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted log loss of texts, each given by the chunks that lead in a feature."""
        kind = self.filters.dtype
        sizes = [len(c) for c, _ in samples]
        chunks, fill = np.concatenate([c for c, _ in samples]), np.concatenate([f for _, f in samples])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = len(chunks)
        best, where = np.full((n, FILTERS), -np.inf, kind), np.zeros((n, FILTERS), np.int64)
        for start, _, y in self.responses(chunks):
            k = y.argmax(1)
            top = np.take_along_axis(y, k[:, None, :], 1)[:, 0]
            better = top > best
            best, where = np.where(better, top, best), np.where(better, start + k * WIDTH, where)
        pre = best + self.bias
        pooled = np.concatenate([np.maximum(pre, 0), fill[:, None]], 1)
        hidden = pooled @ self.second + self.bias2
        feats = np.maximum(hidden, 0)
        top = np.maximum.reduceat(feats, first)
        came = np.array([feats[a : a + s].argmax(0) + a for a, s in zip(first, sizes, strict=True)])
        p = self.probability(top)
        err = ((p - labels) * weight / len(labels)).astype(kind)
        d_last, d_top = top.T @ err, err[:, None] * self.last
        d_hidden = np.zeros_like(hidden)
        np.add.at(d_hidden, (came, np.arange(FEATURES)[None, :]), d_top)
        d_hidden *= hidden > 0
        d_pooled = (d_hidden @ self.second.T)[:, :FILTERS] * (pre > 0)
        # Back to the one row of WIDTH bytes that each filter's largest response came from.
        spots = where[:, :, None] + np.arange(WIDTH)  # chunk, filter, byte
        seen = chunks[np.arange(n)[:, None, None], spots]
        vectors = self.embed[seen].reshape(n, FILTERS, WIDTH * DIM)
        d_filters = np.einsum("nf,nfx->xf", d_pooled, vectors)
        d_vectors = (d_pooled[:, :, None] * self.filters.T[None]).reshape(n, FILTERS, WIDTH, DIM)
        d_embed = np.stack([np.bincount(seen.reshape(-1), d_vectors[..., k].reshape(-1), 256) for k in range(DIM)], 1).astype(kind)
        return {"embed": d_embed, "filters": d_filters.astype(kind), "bias": d_pooled.sum(0), "second": pooled.T @ d_hidden, "bias2": d_hidden.sum(0), "last": d_last, "bias3": np.array([err.sum()], kind)}


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from: the crc32 of the id as text leaves 1 when divided by 3. A null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train_on(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Net:
    """Fits the network to the whole texts of a sample of the labelled rows that are not held out.

    The sample is bounded twice: by train_rows labels of each class, those that come first by a hash of the id, and by
    train_bytes, beyond which the driver takes no more texts. An id with both labels counts as good; of repeated rows
    one is used. Rows with a null id are never used.
    """
    python_ready(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).cast("int").alias("_y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(train_rows)
        picked = part if picked is None else picked.union(part)
    source = docs.select(F.col(id_col).alias("_id"), whole_text(text).cast("binary").alias("_t")).withColumn("_h", F.xxhash64("_t"))
    found = source.join(F.broadcast(picked.withColumnRenamed(id_col, "_id")), "_id")  # 2 * train_rows rows at most
    sizes = found.groupBy("_id", "_h").agg(F.max("_y").alias("_y"), F.max(F.octet_length("_t")).alias("n")).orderBy(F.xxhash64("_id"), "_id", "_h").limit(2 * train_rows).collect()
    room = np.cumsum([r["n"] for r in sizes]) <= train_bytes
    chosen = [(r["_id"], r["_h"]) for r, fits in zip(sizes, room, strict=True) if fits]
    if not chosen:
        return Net()
    keys = docs.sparkSession.createDataFrame(chosen, f"_id {docs.schema[id_col].dataType.simpleString()}, _h long")
    rows = source.join(F.broadcast(keys), ["_id", "_h"]).dropDuplicates(["_id", "_h"]).orderBy(F.xxhash64("_id"), "_id", "_h").collect()  # train_bytes at most
    label_of = {(r["_id"], r["_h"]): r["_y"] for r in sizes}
    return Net().train([bytes(r["_t"]) for r in rows], np.array([label_of[r["_id"], r["_h"]] for r in rows], np.float32))


def score(docs: DataFrame, net: Net, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all of docs if None) and _score, from the whole text. Null counts as empty, and an empty text has a score, too."""
    python_ready(docs.sparkSession)
    kept = list(docs.columns if keep is None else keep)
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], whole_text(text).alias("_t"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(net.scores(b.column("_t").to_pylist()), pa.float64())], [*b.schema.names[:-1], "_score"])

    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + ["_score double"])
    return source.mapInArrow(run, schema).toDF(*kept, "_score")


def keep_good(docs: DataFrame, net: Net, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose score reaches the threshold. Columns may have any names; ids are not read."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = score(docs.toDF(*names), net, names[docs.columns.index(text)])
    return rows.where(F.col("_score") >= threshold).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, net, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
