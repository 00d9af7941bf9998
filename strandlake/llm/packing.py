"""Order-preserving packing of token streams into windows by dynamic programming.

The documents of a partition, in their order, make one stream of ids. Windows of at most seq_len ids are cut from it at
document ends or sentence ends; only where two of those lie further apart than a window, it is cut between other tokens
from the first to the second. The cuts minimise the sum of padding, truncation penalties and a small cost a window. With p the positions at which a cut
may be made, best[j] = penalty[j] + cost + min(best[i] + seq_len - (p[j] - p[i])) over the i within seq_len of j: a
minimum over a sliding window, kept in a monotone queue. A window whose length is a power of two is not padded; those
few i are looked at one by one.

No row moves: each task packs what it reads, block by block, so memory is bounded by a block and a document. The last
window of a block is not emitted; its ids open the next block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import python_ready, table, whole_text
from strandlake.llm.tokens import codec, default_vocabulary

SEQ_LEN = 1024
SENTENCE_PENALTY = 2.0
TOKEN_PENALTY = 8.0
WINDOW_COST = 64.0
BLOCK_TOKENS = 1 << 18


def cut_candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, seq_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions after which a cut is allowed, from 0 to the end, and the penalty of each."""
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE_PENALTY
    penalty[doc_ends] = 0.0
    penalty[0] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    for i in np.flatnonzero(np.diff(at) > seq_len):
        penalty[at[i] + 1 : at[i + 1]] = TOKEN_PENALTY
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, seq_len: int, window_cost: float = WINDOW_COST) -> list[int]:
    """Positions of the cuts of the cheapest sequence of windows from the first candidate to the last, both included."""
    n = len(at)
    place = np.full(int(at[-1]) + 1, -1)
    place[at] = np.arange(n)
    js, ks = [], []  # candidates j and those k that lie a power of two before them
    for size in (1 << e for e in range((seq_len - 1).bit_length())):
        k = place[np.maximum(at - size, 0)]
        hit = np.flatnonzero((k >= 0) & (at >= size))
        js.append(hit)
        ks.append(k[hit])
    j_of = np.concatenate(js) if js else np.empty(0, np.int64)
    even = np.concatenate(ks)[np.argsort(j_of, kind="stable")].tolist() if js else []
    upto = np.cumsum(np.bincount(j_of, minlength=n)).tolist()
    p, pen = at.tolist(), (penalty + (window_cost + seq_len)).tolist()
    best, back = [0.0] * n, [0] * n
    # The queue: keys ascend, and so do the candidates they belong to; its front is at head.
    keys, owners, head, seen = [float(p[0])], [0], 0, 0
    for j in range(1, n):
        pj = p[j]
        while pj - p[owners[head]] > seq_len:
            head += 1
        came = owners[head]
        least = keys[head] - pj
        end = upto[j]
        if end > seen:
            for i in even[seen:end]:
                if best[i] - seq_len < least:
                    least, came = best[i] - seq_len, i
            seen = end
        best[j] = least = least + pen[j]
        back[j] = came
        key = least + pj
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            owners.pop()
        keys.append(key)
        owners.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return [p[j] for j in reversed(cuts)]


class Stream:
    """Packs one partition's documents as they come."""

    def __init__(self, sentence_end: np.ndarray, seq_len: int, first_id: int):
        self.sentence_end, self.seq_len, self.next_id = sentence_end, seq_len, first_id
        self.docs: list[tuple[object, int, int]] = []  # id, ids before those held here, ids of the whole document
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)

    def flush(self, last: bool) -> dict | None:
        """The pieces of the windows that are settled: columns by name."""
        if not self.held:
            return None
        ids = np.concatenate(self.parts)
        doc_ends = np.cumsum([total - skip for _, skip, total in self.docs])
        cuts = best_cuts(*cut_candidates(ids, doc_ends, self.sentence_end, self.seq_len), self.seq_len)
        if not last:
            cuts = cuts[:-1]
        done = cuts[-1]
        bounds = np.union1d(cuts, doc_ends[doc_ends <= done])
        starts, ends = bounds[:-1], bounds[1:]
        doc = np.searchsorted(doc_ends, starts, "right")
        window = np.searchsorted(cuts, starts, "right") - 1
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        skips = np.array([skip for _, skip, _ in self.docs])
        out = {
            "doc": [self.docs[i][0] for i in doc.tolist()],
            "start": starts - doc_starts[doc] + skips[doc],
            "length": ends - starts,
            "doc_tokens": np.array([total for _, _, total in self.docs])[doc],
            "sequence_id": self.next_id + window,
            "offset": starts - np.asarray(cuts)[window],
            "ids": pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((bounds * 4).astype("<i4").tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]),
        }
        self.next_id += len(cuts) - 1
        first = int(np.searchsorted(doc_ends, done, "right"))
        left = self.docs[first:]
        if left:
            left[0] = (left[0][0], int(done - doc_starts[first] + skips[first]), left[0][2])
        self.docs, self.parts, self.held = left, [ids[done:]] * bool(left), len(ids) - int(done)
        return out if len(starts) else None


def pack(docs: DataFrame, vocabulary: str, seq_len: int = SEQ_LEN, end_id: int = 0, text: str = "text", id_col: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces: the id column, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit).

    Every id of every row of docs lies in exactly one piece, end_id behind each text included. Null counts as empty (one
    id, the end_id); ids may be null or repeat, each row is a document of its own. A sequence_id is the partition's
    number and a count within it, so a task run again gives the same ones.
    """
    python_ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        c = codec(vocabulary)
        sentence_end = np.array([b[-1:] in (b".", b"!", b"?", b"\n") for b in c.bytes_of])
        stream, id_type = Stream(sentence_end, seq_len, TaskContext.get().partitionId() << 36), pa.int64()

        def rows(x):
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"], id_type), *(pa.array(x[k], pa.int64()) for k in names[1:-1]), x["ids"]], names)

        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                stream.add(doc_id, np.append(c.encode(t), np.uint32(end_id)))
                if stream.held >= block_tokens and (x := stream.flush(False)):
                    yield from rows(x)
        if x := stream.flush(True):
            yield from rows(x)

    return docs.select(F.col(id_col), whole_text(text).alias("_t")).mapInArrow(run, f"{id_col} {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def digest_pieces(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of pack's pieces, the crc32 of the ids in place of the ids; null ids stay null."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return digest_pieces(pack(table(spark, sf_dir, "documents"), default_vocabulary()))
