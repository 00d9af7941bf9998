"""Near-duplicates by SimHash: tiled exact comparison of fingerprints.

Each document gets a 64-bit fingerprint from its word shingles; documents of equal fingerprints are one node. Two nodes
are linked if their fingerprints differ in at most RADIUS bits. Of RADIUS + 1 disjoint blocks of bits, two such
fingerprints share one, so only nodes with an equal block meet: each node goes to one bucket for each block. A bucket's
fingerprints are laid out in tiles of a bounded size, and tile pairs are compared in numpy by exclusive-or and bit
counts; tile pairs whose population counts differ by more than the radius are skipped. No link is lost by this, and a
bucket of any size is spread over tasks by its tiles.

A tile pair returns a spanning forest of its links instead of all pairs, so a group of n near copies gives about n rows.
Components are then joined by alternating star operations on written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, python_ready, table, whole_text

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: The most fingerprints of a tile, and of the blocks in which two tiles are compared.
TILE, SUBTILE = 4096, 256
#: Shingles hashed at once, which bounds memory for long texts.
HASHED_AT_ONCE = 1 << 15


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles, repeats included; 0 if there are no words."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, white space is space and \t to \r
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    set_in = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, HASHED_AT_ONCE):
        part = words[i : i + HASHED_AT_ONCE + shingle_words - 1]
        m = max(1, len(part) - shingle_words + 1)
        hashes = np.fromiter([digest(b" ".join(part[k : k + shingle_words]), SEED) for k in range(m)], np.uint64, m)
        set_in += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The columns to keep (all of docs if None) and _fp, the fingerprint as a signed long."""
    python_ready(docs.sparkSession)
    kept = list(docs.columns if keep is None else keep)
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], whole_text(text).alias("_t"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in b.column("_t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], [*b.schema.names[:-1], "_fp"])

    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + ["_fp long"])
    return source.mapInArrow(run, schema).toDF(*kept, "_fp")


class Forest:
    """Union-find over the fingerprints of a tile pair, with labels kept as an array."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            apart = self.label[i] != self.label[j]
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            # One link for each pair of labels; unions among these are found by walking, then all labels are set at once.
            keys = self.label[i].astype(np.int64) * len(self.label) + self.label[j]
            _, first = np.unique(keys, return_index=True)
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            for k in first.tolist():
                a, b = find(int(self.label[i[k]])), find(int(self.label[j[k]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    self.edges.append((int(i[k]), int(j[k])))
            to = np.arange(len(self.label))
            for x in root:
                to[x] = find(x)
            self.label = to[self.label]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, subtile: int = SUBTILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a (b is None) or between a and b: two arrays of fingerprints."""
    one = b is None
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    b = a if one else b[np.argsort(np.bitwise_count(b), kind="stable")]
    pa_, pb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    forest = Forest(len(a) + (0 if one else len(b)))
    shift = 0 if one else len(a)
    for i in range(0, len(a), subtile):
        rows = a[i : i + subtile]
        low, high = pa_[i], pa_[min(i + subtile, len(a)) - 1]
        for j in range(i if one else 0, len(b), subtile):
            if pb[j] - high > radius:
                break
            if low - pb[min(j + subtile, len(b)) - 1] > radius:
                continue
            near = np.bitwise_count(rows[:, None] ^ b[None, j : j + subtile]) <= radius
            x, y = np.nonzero(near)
            forest.link(x + i, y + j + shift)
    both = a if one else np.concatenate([a, b])
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    return both[edges[:, 0]], both[edges[:, 1]]


def links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v), u > v, between the distinct fingerprints in column fp, with the same components as all links."""
    python_ready(nodes.sparkSession)
    n = radius + 1
    width = [64 // n + (k < 64 % n) for k in range(n)]
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", sum(width[:k])).bitwiseAND(F.lit((1 << width[k]) - 1)).alias("value")) for k in range(n)]
    keyed = nodes.select("fp", F.inline(F.array(*blocks))).withColumn("pop", F.bit_count("fp").cast("int"))
    sized = keyed.groupBy("block", "value", "pop").agg(F.count(F.lit(1)).alias("m"))
    whole = sized.groupBy("block", "value").agg(F.sum("m").alias("bucket"))
    plan = sized.join(whole, ["block", "value"]).where(F.col("bucket") > tile).select("block", "value", "pop", F.ceil(F.col("m") / F.lit(tile)).cast("int").alias("tiles"))
    plan = scratch.save(plan, "plan")
    placed = keyed.join(plan, ["block", "value", "pop"], "left").select("fp", "block", "value", F.when(F.col("tiles").isNull(), -1).otherwise(F.col("pop")).alias("pop"), F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("tiles"))).cast("int").alias("salt"))
    tiles = scratch.save(placed.groupBy("block", "value", "pop", "salt").agg(F.collect_list("fp").alias("fps")), "tiles")  # about `tile` fingerprints each
    left, right = tiles.where("pop >= 0").alias("x"), tiles.where("pop >= 0").alias("y")
    order = (F.col("y.pop") > F.col("x.pop")) | ((F.col("y.pop") == F.col("x.pop")) & (F.col("y.salt") > F.col("x.salt")))
    same = (F.col("x.block") == F.col("y.block")) & (F.col("x.value") == F.col("y.value"))
    across = left.join(right, same & order & (F.col("y.pop") - F.col("x.pop") <= radius)).select(F.col("x.fps").alias("a"), F.col("y.fps").alias("b"))
    within = tiles.where(F.size("fps") > 1).select(F.col("fps").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))

    def lists(column) -> list[np.ndarray | None]:
        flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        ends = column.offsets.to_numpy()
        return [flat[ends[i] : ends[i + 1]] if column[i].is_valid else None for i in range(len(column))]

    def compare(batches):
        for batch in batches:
            us, vs = [], []
            for a, b in zip(lists(batch.column(0)), lists(batch.column(1)), strict=True):
                u, v = tile_links(a, b, radius)
                us.append(u)
                vs.append(v)
            u, v = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    return within.union(across).mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """For each node u of edges that is not the smallest of its component: (u, root), root the smallest.

    Alternates two steps: each node's larger neighbours, then its smaller ones, are tied to the smallest in reach. The
    minimum of a node's neighbours is an aggregate and is joined back, so no node's neighbours need fit a task.
    """
    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}_0")
    k = 0
    while True:
        one_each = now.groupBy("u").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).count() == 0
        if one_each and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
            return now.withColumnRenamed("v", "root")
        k += 1
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{name}_{k}_large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = scratch.save(small, f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
        scratch.drop(f"{name}_{k}_large")


def groups(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """For each distinct fingerprint fp of fps (id column, _fp): component_id, the smallest id in reach, and top, the fingerprint that holds it."""
    nodes = scratch.save(fps.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("first")), "nodes")
    found = components(links(nodes, scratch, radius), scratch)
    rooted = nodes.join(found, nodes["fp"] == found["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # A null id is larger than any other here, and a component of null ids alone has a null component_id.
    smallest = F.min(F.struct(F.col("first").isNull(), F.col("first"), F.col("fp")))
    least = rooted.groupBy("root").agg(smallest.alias("s")).select("root", F.col("s.first").alias("component_id"), F.col("s.fp").alias("top"))
    return rooted.join(least, "root").select("fp", "component_id", "top")


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of docs: the id column, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Null counts as empty; texts without words share the fingerprint zero and are linked like any others. Repeated rows
    each get a row.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(with_fingerprints(docs, text, [id_col], shingle_words), "fps")
    found = groups(fps, scratch, radius, id_col)
    return fps.join(found, fps["_fp"] == found["fp"]).select(F.col(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all their columns, of the smallest id of each component; of rows with that id and fingerprint, one."""
    scratch = Scratch(docs.sparkSession, "simhash")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id = names[docs.columns.index(id_col)]
    rows = scratch.save(with_fingerprints(docs.toDF(*names), names[docs.columns.index(text)]), "rows")
    fps = rows.select(F.col(own_id).alias("_own"), "_fp")
    tops = groups(fps, scratch, radius, "_own").where("fp = top").select(F.col("fp").alias("_top"), F.col("component_id").alias("_id"))
    keys = fps.join(tops, (fps["_fp"] == tops["_top"]) & fps["_own"].eqNullSafe(tops["_id"])).groupBy("_top", "_id").agg(F.count(F.lit(1)).alias("_copies"))
    kept = rows.join(keys, (rows["_fp"] == keys["_top"]) & rows[own_id].eqNullSafe(keys["_id"]))
    kept = kept.where("_copies = 1").union(kept.where("_copies > 1").dropDuplicates(["_top", "_id"]))
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
