"""Byte-level BPE encoding by tree concatenation.

The vocabulary is a tokenizers JSON file (its path is a parameter). Encoding of short text is one call of a native BPE
library with the ranks read from that file. Long text is encoded in halves, down to leaves of a bounded size; leaves of
one text are encoded by different tasks. Two neighbours are then joined by encoding a window around the join again, and
growing it until both of its sides agree with what stands there, in two nested steps:

* Between pieces that the pre-tokenizer makes. How a text is split from some character on depends only on what follows
  it. Between a letter and a space with a letter behind it a piece always ends, so splitting starts anew at the last
  such place of the left side, or at its beginning. As soon as a piece ends where one of the right side's own ends, all
  later pieces are the right side's.
* Within one long piece. A token sequence is the encoding of its bytes exactly if each adjacent pair is the encoding of
  the pair's bytes. So if a window's encoding begins with the token that stood there before and ends with the one that
  stood there before, every adjacent pair is one that was seen in an encoding, and the whole is exact.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import python_ready, table, whole_text

LEAF_CHARS = 1 << 15
#: Fixed values of the byte-level format: the pre-tokenizer's pattern, and the bytes that stand for themselves in a vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces, in possessive form, which the native library matches with less backtracking.
FAST_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PLAIN_BYTES = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
#: Pieces of more bytes than this are halved.
PIECE_BYTES = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def has_long_run(text: str, limit: int) -> bool:
    """Whether more than limit characters follow each other without white space."""
    at = 0
    while len(text) - at > limit:
        space = text.rfind(" ", at, at + limit + 1)
        if space < 0:  # no blank, but perhaps other white space
            return len(max(text.split(), key=len, default="")) > limit
        at = space + 1
    return False


class Codec:
    """Encodes as the tokenizers library does with add_special_tokens=False, and decodes with skip_special_tokens=False."""

    def __init__(self, path: str, piece_bytes: int = PIECE_BYTES, leaf_chars: int = LEAF_CHARS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [b for lo, hi in PLAIN_BYTES for b in range(lo, hi + 1)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.n_bytes = np.array([len(b) for b in self.bytes_of])
        self.engine = tiktoken.Encoding("own", pat_str=FAST_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.piece_bytes, self.leaf_chars = piece_bytes, leaf_chars

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text of any length, as uint32."""
        if len(text) <= self.leaf_chars:
            return self.encode_leaf(text)
        mid = len(text) // 2
        return self.join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def encode_leaf(self, text: str) -> np.ndarray:
        if "<|" in text or has_long_run(text, self.piece_bytes // 4):
            ids = [self._ids(text[a:b]) for a, b in self.pieces(text)]
            return np.concatenate(ids) if ids else np.empty(0, np.uint32)
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    def pieces(self, text: str, at: int = 0) -> Iterator[tuple[int, int]]:
        """Where the pre-tokenizer's pieces, and special tokens, begin and end."""
        specials = [m.span() for m in self.special_re.finditer(text, at)]
        for a, b in [*specials, (len(text), len(text))]:
            for m in self.split.finditer(text, at, a):
                yield m.span()
            if b > a:
                yield a, b
            at = b

    def _ids(self, piece: str) -> np.ndarray:
        found = self.special.get(piece)
        return np.array([found], np.uint32) if found is not None else self.encode_piece(piece.encode("utf-8", "replace"))

    def encode_piece(self, raw: bytes) -> np.ndarray:
        """Ids of one piece of the pre-tokenizer: halves first, then the join."""
        if len(raw) <= self.piece_bytes:
            return np.array(self.engine._encode_single_piece(raw), np.uint32)
        mid = len(raw) // 2
        return self.join_tokens(self.encode_piece(raw[:mid]), self.encode_piece(raw[mid:]))

    def join_tokens(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of the concatenation of two parts of one piece."""
        k = 8
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            new = np.array(self.engine._encode_single_piece(self.raw(left[len(left) - a :]) + self.raw(right[:b])), np.uint32)
            starts = a == len(left) or new[0] == left[len(left) - a]
            ends = b == len(right) or new[-1] == right[b - 1]
            if starts and ends:
                return np.concatenate([left[: len(left) - a], new, right[b:]])
            k *= 2

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The encoding of left + right, from those of both."""
        window = 256
        at = 0
        while window < len(left):
            found = [m.end() for m in WORD_END.finditer(left, len(left) - window, len(left))]
            if found:
                at = found[0]
                break
            window *= 4
        head = self._count(left_ids[::-1], len(left[at:].encode("utf-8", "replace")))
        near, edge, shift = left[at:] + right, len(left) - at, 0
        own, own_end, first_end = self.pieces(right), 0, None
        tail_start = 0  # of the left side's own last piece, within near
        for tail_start, _ in self.pieces(left[at:]):
            pass
        new, agreed = [], len(near)
        for a, b in self.pieces(near):
            while own_end < b - edge:
                _, own_end = next(own, (0, len(right) + 1))
                first_end = first_end or own_end
            if a == tail_start and a < edge < b and b - edge == first_end and (b - a) * 4 > self.piece_bytes:
                n = self._count(left_ids[::-1], len(left[at + a :].encode("utf-8", "replace")))
                m = self._count(right_ids, len(near[edge:b].encode("utf-8", "replace")))
                new.append(self.join_tokens(left_ids[len(left_ids) - n :], right_ids[:m]))
            else:
                new.append(self._ids(near[a:b]))
            if b > edge and own_end == b - edge:
                agreed = b
                break
        tail = self._count(right_ids, len(near[edge:agreed].encode("utf-8", "replace")))
        return np.concatenate([left_ids[: len(left_ids) - head], *new, right_ids[tail:]])

    def _count(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up so many bytes."""
        if n_bytes == 0:
            return 0
        k = 64
        while True:
            ends = np.cumsum(self.n_bytes[ids[:k]])
            if ends[-1] >= n_bytes or k >= len(ids):
                return int(np.searchsorted(ends, n_bytes)) + 1
            k *= 8

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")


#: Where a piece ends whatever stands before and behind.
WORD_END = regex.compile(r"\p{L}(?= \p{L})")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def _digest(doc_id, ids: np.ndarray, c: Codec) -> tuple:
    text = c.decode(ids)
    return doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per row of docs: the id column and ids (binary, little-endian unsigned 32-bit).

    Texts of up to leaf_chars characters are encoded where they are read. Longer ones are cut into leaves that go to
    different tasks; the leaves of a text then meet and are joined pairwise, level by level. Null counts as empty;
    rows equal in id and text are encoded once and come out as often as they went in. A null id is an id like any other.
    Of a long text, its leaves and their ids meet in one task.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text).alias("_t"))
    kind = docs.schema[id_col].dataType.simpleString()
    n = F.char_length("_t")

    def short(batches):
        c = codec(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t).astype("<u4").tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["_id", "ids"])

    def leaves(batches):
        c = codec(vocabulary)
        for b in batches:
            ids = pa.array([c.encode(t).astype("<u4").tobytes() for t in b.column("leaf").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    def joined(group: pa.Table) -> pa.Table:
        c = codec(vocabulary)
        group = group.sort_by("no")
        no, leaf, ids = (group.column(k).to_pylist() for k in ("no", "leaf", "ids"))
        level = [(x, np.frombuffer(i, "<u4").astype(np.uint32)) for x, i in zip(leaf, ids, strict=True)]
        while len(level) > 1:
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [p[0] if len(p) == 1 else (p[0][0] + p[1][0], c.join(*p[0], *p[1])) for p in pairs]
        return pa.table({"_id": group.column("_id").slice(0, 1), "copies": group.column("copies").slice(0, 1), "ids": pa.array([level[0][1].astype("<u4").tobytes()], pa.binary())})

    cut = rows.where(n > leaf_chars).select("_id", F.sha2("_t", 256).alias("_sha"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / leaf_chars).cast("int")), lambda i: F.substring(F.col("_t"), i * leaf_chars + 1, F.lit(leaf_chars)))).alias("no", "leaf"))
    once = cut.groupBy("_id", "_sha", "no").agg(F.first("leaf").alias("leaf"), F.count(F.lit(1)).alias("copies"))
    encoded = once.select("_id", "_sha", "no", "copies", "leaf").mapInArrow(leaves, f"_id {kind}, _sha string, no int, copies long, leaf string, ids binary")
    long = encoded.groupBy("_id", "_sha").applyInArrow(joined, f"_id {kind}, copies long, ids binary")
    long = long.select("_id", "ids", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_id", "ids")
    return rows.where(n <= leaf_chars).mapInArrow(short, f"_id {kind}, ids binary").union(long).withColumnRenamed("_id", id_col)


def digests(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256, and decoded_sha256 of what the ids decode to."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            rows = [_digest(None, np.frombuffer(x, "<u4"), c) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), default_vocabulary()), default_vocabulary())
