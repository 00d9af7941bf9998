"""Files of token ids in bit or byte planes.

A file holds the ids of consecutive documents. Ids are cut into chunks of a fixed number; a chunk is transposed into
planes (of bytes: all lowest bytes, then all second ones, and so on; of bits likewise), and each plane is compressed
with zstandard. Layout, all numbers little-endian:

    magic (8 bytes) | chunks: the planes of each, one behind the other | documents | chunk index | footer | magic

The documents section is an Arrow IPC stream (id, n_tokens), compressed. The chunk index has, for each chunk, its
offset (u64), its number of ids (u32), and the compressed size of each plane (u32). The footer has the offset and size
of the documents section, the offset of the index, the number of chunks, ids a chunk, and planes (each u64).
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, python_ready, table, whole_text
from strandlake.llm.tokens import codec, default_vocabulary

MAGIC = b"SLTOKEN1"
FOOTER = struct.Struct("<6Q")
CHUNK_IDS = 1 << 16


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """planes: 'byte' (four planes) or 'bit' (32)."""
    raw = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == "byte":
        return [row.tobytes() for row in raw]
    return [np.packbits((row >> bit) & 1).tobytes() for row in raw for bit in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]
        raw = np.stack([sum(bits[8 * k + b] << b for b in range(8)).astype(np.uint8) for k in range(4)])
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


class Writer:
    def __init__(self, out, planes: str = "byte", chunk_ids: int = CHUNK_IDS, level: int = 3):
        self.out, self.planes, self.chunk_ids = out, planes, chunk_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.docs, self.waiting, self.held, self.n_ids = 0, [], ([], []), [], 0, 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs[0].append(doc_id)
        self.docs[1].append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.chunk_ids:
            all_ids = np.concatenate(self.waiting)
            whole = len(all_ids) // self.chunk_ids * self.chunk_ids
            for i in range(0, whole, self.chunk_ids):
                self._chunk(all_ids[i : i + self.chunk_ids])
            self.waiting, self.held = [all_ids[whole:]], len(all_ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        zipped = [self.zip.compress(p) for p in to_planes(ids, self.planes)]
        self.index.append(struct.pack(f"<QI{len(zipped)}I", self.at, len(ids), *map(len, zipped)))
        for z in zipped:
            self._put(z)

    def close(self, id_type: pa.DataType) -> None:
        if self.held:
            self._chunk(np.concatenate(self.waiting))
        sink = io.BytesIO()
        docs = pa.record_batch([pa.array(self.docs[0], id_type), pa.array(self.docs[1], pa.uint32())], ["id", "n_tokens"])
        with pa.ipc.new_stream(sink, docs.schema) as s:
            s.write_batch(docs)
        docs_at, packed = self.at, self.zip.compress(sink.getvalue())
        self._put(packed)
        index_at = self.at
        self._put(b"".join(self.index))
        self._put(FOOTER.pack(docs_at, len(packed), index_at, len(self.index), self.chunk_ids, 4 if self.planes == "byte" else 32) + MAGIC)


class Reader:
    def __init__(self, f, size: int):
        self.f = f
        tail = self._get(size - FOOTER.size - len(MAGIC), FOOTER.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file, or cut off")
        docs_at, docs_size, index_at, n_chunks, self.chunk_ids, self.n_planes = FOOTER.unpack(tail[: FOOTER.size])
        self.unzip = zstandard.ZstdDecompressor()
        with pa.ipc.open_stream(self.unzip.decompress(self._get(docs_at, docs_size))) as s:
            self.docs = s.read_all()
        entry = struct.Struct(f"<QI{self.n_planes}I")
        self.index = list(entry.iter_unpack(self._get(index_at, n_chunks * entry.size)))

    def _get(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        data, planes, i = self._get(at, sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unzip.decompress(data[i : i + s]))
            i += s
        return from_planes(planes, n)

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """Each document's id, the number of ids before it in this file, and its ids, in file order."""
        held, k, start = np.empty(0, np.uint32), 0, 0
        for doc_id, n in zip(self.docs.column("id").to_pylist(), self.docs.column("n_tokens").to_pylist(), strict=True):
            if len(held) < n:
                more = [held]
                while sum(map(len, more)) < n:
                    more.append(self.chunk(k))
                    k += 1
                held = np.concatenate(more)
            yield doc_id, start, held[:n]
            held, start = held[n:], start + n


def _open(uri: str):
    """A file system that reaches the shared folder from any executor, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, text: str = "text", id_col: str = "doc_id", planes: str = "byte", chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Writes the ids of all documents in ascending order of id to files in the shared folder; returns one row per file.

    Columns: shard, uri, n_ids, n_docs, start (ids in all files before it). Rows are dealt by ranges of (id, hash of the
    text): null ids come first, repeated ids lie side by side in an order that their texts fix, and no id, however
    often it repeats, must fit one task. Null text counts as empty. Files of a failed task carry another attempt's number
    and stay unlisted.
    """
    spark = docs.sparkSession
    python_ready(spark)
    scratch = Scratch(spark, "token_files")
    root = scratch.root + "/shards"

    def run(batches):
        c, context = codec(vocabulary), TaskContext.get()
        uri = f"{root}/{context.partitionId():06d}-{context.taskAttemptId()}.sltok"
        first = next(batches, None)
        if first is None:
            return
        system, path = _open(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            w = Writer(out, planes, chunk_ids)
            b = first
            while b is not None:
                for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w.add(doc_id, np.append(c.encode(t), np.uint32(end_id)))
                b = next(batches, None)
            w.close(first.schema.field(0).type)
        yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "uri": [uri], "n_ids": [w.n_ids], "n_docs": [len(w.docs[0])]}, pa.schema([("shard", pa.int64()), ("uri", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    rows = docs.select(F.col(id_col), whole_text(text).alias("_t")).withColumn("_h", F.xxhash64("_t"))
    dealt = rows.repartitionByRange(id_col, "_h").sortWithinPartitions(id_col, "_h", "_t").select(id_col, "_t")
    files = scratch.save(dealt.mapInArrow(run, "shard long, uri string, n_ids long, n_docs long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, id_type: str = "bigint", id_col: str = "doc_id", n_tasks: int | None = None) -> DataFrame:
    """Per document of the files, in file order within each: the id, start (ids of all documents before it), ids (binary)."""
    spark = files.sparkSession
    python_ready(spark)
    arrow_ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def run(batches):
        for b in batches:
            for uri, first in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                system, path = _open(uri)
                with system.open_input_file(path) as f:
                    out, held = ([], [], []), 0
                    for doc_id, start, ids in Reader(f, f.size()).documents():
                        for x, v in zip(out, (doc_id, first + start, ids.astype("<u4").tobytes()), strict=True):
                            x.append(v)
                        held += len(ids)
                        if held > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(out[0], arrow_ids), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], [id_col, "start", "ids"])
                            out, held = ([], [], []), 0
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], arrow_ids), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], [id_col, "start", "ids"])

    n = n_tasks or max(1, 2 * spark.sparkContext.defaultParallelism)
    return files.select("uri", "start").repartition(n).mapInArrow(run, f"{id_col} {id_type}, start long, ids binary")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=2)
    back = read_token_files(files)
    return back.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
