"""Line deduplication by a segment-partition edit join.

Lines link if their edit distance is at most THRESHOLD characters. A line is split into THRESHOLD + 1 segments; of two
linked lines, one has a segment that the other contains unchanged, near the same place. So each line is filed under its
own segments and looks up those substrings of itself that could be a segment of a line as long, or up to THRESHOLD
shorter; which substrings these are follows from the position of the segment and the difference in length. Lines that
meet under a key are verified by a banded bit-parallel edit distance, many pairs at once. Lines of at most THRESHOLD
characters have no segments: they meet each other, and longer lines by common subsequences (see short_keys).

Texts don't travel with the keys: a key row has hashes only, tasks send each line's keys once, and texts are fetched for
lines that met another under a key. If many lines meet under one key, what is left of them without the shared segment is
again within the threshold, so they are split into segments a second and third time and meet only under two or three
shared segments. What is still a large meeting is dealt into tiles, whose pairs go to different tasks; a task returns a
spanning forest of the links it finds, not all pairs. Lines are told apart by 128 bits of hashes, and under a key by 64.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, python_ready, table, whole_text
from strandlake.llm.simhash import Forest, components

THRESHOLD = 2
#: The most lines of a tile, about.
TILE = 256
#: Meetings of more lines than this are split by further segments, at most so many times.
LARGE, SPLITS = 256, 3
#: Bits of the filter through which lines pass before those that are wanted are joined: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
#: A task remembers so many lines whose keys it has sent.
REMEMBERED = 1 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=1 << 16)
def lookups(n: int, threshold: int) -> np.ndarray:
    """Rows (length of the filed line, segment, start in this line, segment's length, filed) for a line of n characters.

    filed marks a line's own segments; they are also lookups in lines as long. Lines of more than threshold characters
    only, on both sides.
    """
    out = []
    parts = threshold + 1
    for gap in range(min(threshold, n - parts) + 1):
        m = n - gap
        for i in range(parts):
            # Segments as even as possible, the longer ones last.
            short = parts - m % parts
            size = m // parts + (i >= short)
            at = i * (m // parts) + max(0, i - short)
            low = max(-i, gap - (threshold - i))
            high = min(i, gap + (threshold - i))
            out += [(m, i, at + d, size, gap == 0 and d == 0) for d in range(low, high + 1) if 0 <= at + d and at + d + size <= n]
    return np.array(out, np.int64).reshape(-1, 5)


@lru_cache(maxsize=1 << 16)
def short_keys(line: str, threshold: int) -> tuple[tuple[int, bool], ...]:
    """(key, filed) by which a line meets lines of at most threshold characters; none for lines twice as long and more.

    Any two lines of at most threshold characters are within it. A longer line of n characters within the threshold of a
    short one keeps n - threshold characters of it, in order: both know that subsequence.
    """

    def key(*what) -> int:
        return xxhash.xxh64_intdigest(repr(what).encode("utf-8", "surrogatepass")) | 1

    n = len(line)
    if n > 2 * threshold:
        return ()
    if n > threshold:
        return tuple((key(n, x), False) for x in sorted(set(combinations(line, n - threshold))))
    longer = range(threshold + 1, 2 * threshold + 1)
    return ((key(0), True), *((key(m, x), True) for m in longer for x in sorted(set(combinations(line, m - threshold)))))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def keys_of(lines: list[str], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line number, key, filed, start, size) of all lookups of the lines. Hashes of substrings come from running sums of each line.

    Keys of segments are even. Those of short_keys are odd, and have no start and size.
    """
    sizes = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    up, down = _powers(BASE, int(sizes.max(initial=0))), _powers(INVERSE, int(sizes.max(initial=0)))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[place], dtype=np.uint64)])
        plans = [lookups(int(n), threshold) for n in sizes]
        who = np.repeat(np.arange(len(lines)), [len(p) for p in plans])
        rows = np.concatenate(plans) if plans else np.empty((0, 5), np.int64)
        at = starts[who] + rows[:, 2]
        h = (sums[at + rows[:, 3]] - sums[at]) * down[rows[:, 2]]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h + rows[:, 0].astype(np.uint64) * np.uint64(0x94D049BB133111EB) + rows[:, 1].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) & ~np.uint64(1)
    found = [who, h, rows[:, 4].astype(bool), rows[:, 2], rows[:, 3]]
    more = [(k, key, filed) for k in np.flatnonzero(sizes <= 2 * threshold).tolist() for key, filed in short_keys(lines[k], threshold)]
    if more:
        none = np.zeros(len(more), np.int64)
        extra = [np.array([x[0] for x in more], np.int64), np.array([x[1] for x in more], np.uint64), np.array([x[2] for x in more], bool), none, none]
        found = [np.concatenate(x) for x in zip(found, extra, strict=True)]
    return found[0], found[1].view(np.int64), *found[2:]


def under(parent: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys of what is left of lines that met under the parent key; whether a key is even stays as it is. No parent is 0."""
    with np.errstate(over="ignore"):
        mixed = parent.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(31))) & ~np.uint64(1)).view(np.int64) ^ key


def within(a: list[str], b: list[str], threshold: int) -> np.ndarray:
    """For each pair of texts, both longer than the threshold, whether their edit distance is at most that.

    Bit k of a pair's words stands for the row j - threshold + k of column j: the band of 2 * threshold + 1 cells around
    the diagonal, one row further down with each column. The distance is followed along the band's lowest diagonal to
    the last row, and from there along it. Pairs that can't come back under the threshold leave early.
    """
    t, width = threshold, 2 * threshold + 1
    m, n = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    result = np.zeros(len(a), bool)
    live = np.flatnonzero(np.abs(m - n) <= t)
    if not len(live):
        return result
    m, n = m[live], n[live]

    def matrix(texts: list[str], left: int, columns: int, fill: int) -> np.ndarray:
        out = np.full((len(live), columns), fill, np.uint32)
        for row, i in enumerate(live.tolist()):
            codes = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            out[row, left : left + len(codes)] = codes + 2
        return out

    columns = int(n.max())
    x, y = matrix(a, t, columns + width + t, 0), matrix(b, 0, columns, 1)
    bits = np.uint64(1) << np.arange(width, dtype=np.uint64)
    mask, one = np.uint64((1 << width) - 1), np.uint64(1)
    vp, vn = np.full(len(live), ((1 << (t + 1)) - 1) << t, np.uint64), np.zeros(len(live), np.uint64)
    score = np.full(len(live), t, np.int64)
    for j in range(1, columns + 1):
        match = ((x[:, j - 1 : j - 1 + width] == y[:, j - 1 : j]) * bits).sum(1, dtype=np.uint64)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        row_bit = np.clip(m - j + t, 0, width - 1).astype(np.uint64)
        down = j <= m - t
        score += np.where(down, 1 - (d0 >> np.uint64(width - 1) & one).astype(np.int64), (hp >> row_bit & one).astype(np.int64) - (hn >> row_bit & one).astype(np.int64))
        vp, vn = (hn | ~((d0 >> one) | hp)) & mask, (d0 >> one) & hp
        ended = j == n
        if ended.any():
            result[live[ended]] = score[ended] <= t
        if j % 16 == 0 or ended.any():
            stay = (j < n) & ~(score > t + n - np.minimum(j, m - t) - np.maximum(0, m - t - j))
            if not stay.all():
                live, m, n, x, y, vp, vn, score = live[stay], m[stay], n[stay], x[stay], y[stay], vp[stay], vn[stay], score[stay]
                if not len(live):
                    break
    return result


def verified(lines: list[str], i: np.ndarray, j: np.ndarray, threshold: int, cells: int = 1 << 21) -> np.ndarray:
    """Which pairs of lines are within the threshold; pairs of like length are compared together, of bounded total size."""
    out = np.zeros(len(i), bool)
    # A common beginning changes no distance, and makes the shortest lines longer than the threshold.
    lines = [" " * (threshold + 1) + x for x in lines] if min(map(len, lines), default=0) <= threshold else lines
    sizes = np.array([len(x) for x in lines], np.int64)
    order = np.argsort(np.maximum(sizes[i], sizes[j]), kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(8192, cells // (int(sizes[i[order[min(len(order) - 1, at + 64)]]]) + 64)))
        pick = order[at : at + n]
        out[pick] = within([lines[k] for k in i[pick].tolist()], [lines[k] for k in j[pick].tolist()], threshold)
        at += n
    return out


def _lines(docs: DataFrame, text: str, *more: str) -> DataFrame:
    return docs.select(*more, F.posexplode(F.split(whole_text(text), "\n")).alias("pos", "line")).where(F.length(F.trim("line")) > 0)


def _met(keyed: DataFrame) -> DataFrame:
    """Of rows (key, parent, h, filed), those of the keys that one h is filed under and that another h has, too.

    Rows come sorted by key, those filed first. So what a key's first row says, and whether an h other than its first
    one has come, is all that is held between batches, however many rows a key has.
    """
    names = ["key", "parent", "h", "filed"]

    def run(batches):
        held = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]  # rows of the last key seen that have met no other h so far
        good_key: int | None = None  # the last key seen, if its lines have met
        for b in batches:
            cols = [np.concatenate([x, b.column(k).to_numpy(zero_copy_only=False)]) for k, x in zip(names, held, strict=True)]
            if not len(cols[0]):
                continue
            key, _, h, filed = cols
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            low, high = np.minimum.reduceat(h, first), np.maximum.reduceat(h, first)
            good = (low != high) & filed[first]
            if good_key is not None:
                good[0] |= key[0] == good_key
            open_ = not good[-1] and low[-1] == high[-1] and bool(filed[first[-1]])
            keep = np.repeat(good, size)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)
            good_key = int(key[-1]) if good[-1] else None
            # One filed and one other row of that h are enough; a key without a filed row never becomes good.
            last = slice(int(first[-1]), None)
            _, pick = np.unique(filed[last], return_index=True)
            held = [c[last][np.sort(pick)] for c in cols] if open_ else [c[:0] for c in cols]

    return keyed.repartition("key").sortWithinPartitions(F.col("key"), F.col("filed").desc()).mapInArrow(run, "key long, parent long, h long, filed boolean")


def _meetings(lines: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """(key, h, filed) of the lines that meet another one under a key that one of them is filed under."""

    def emit(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            new = []
            for k, pair in enumerate(zip(b.column("h").to_pylist(), b.column("g").to_pylist(), strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    new.append(k)
            if len(seen) > REMEMBERED:
                seen.clear()
            part = b.take(pa.array(new, pa.int64()))
            h = part.column("h").to_numpy()
            who, key, filed, _, _ = keys_of(part.column("line").to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(h[who]), pa.array(filed)], ["key", "h", "filed"])

    keyed = lines.mapInArrow(emit, "key long, h long, filed boolean").select("key", F.lit(0).cast("long").alias("parent"), "h", "filed")
    return scratch.save(_met(keyed).groupBy("key", "h").agg(F.bool_or("filed").alias("filed")), "meetings")


def _split(rows: DataFrame, threshold: int, scratch: Scratch, level: int) -> DataFrame:
    """Rows (key, parent, node, filed, rest) of large meetings, met again under the segments of what is left of each rest."""

    def strip(batches):
        """Rests without the segment that their key stands for; the same key may stand for several places."""
        for b in batches:
            rests = b.column("rest").to_pylist()
            key, parent, node = (b.column(k).to_numpy() for k in ("key", "parent", "node"))
            who, found, _, at, size = keys_of(rests, threshold)
            hit = np.flatnonzero(under(parent[who], found) == key[who])
            left = sorted({(w, rests[w][:a] + rests[w][a + n :]) for w, a, n in zip(who[hit].tolist(), at[hit].tolist(), size[hit].tolist(), strict=True)})
            row = np.array([w for w, _ in left], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(node[row]), pa.array([x for _, x in left], pa.string())], ["parent", "node", "rest"])

    def emit(batches):
        for b in batches:
            parent, node = b.column("parent").to_numpy(), b.column("node").to_numpy()
            who, key, filed, _, _ = keys_of(b.column("rest").to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(under(parent[who], key)), pa.array(parent[who]), pa.array(node[who]), pa.array(filed)], ["key", "parent", "h", "filed"])

    cut = scratch.save(rows.select("key", "parent", "node", "rest").mapInArrow(strip, "parent long, node long, rest string"), f"cut_{level}")
    met = _met(cut.mapInArrow(emit, "key long, parent long, h long, filed boolean")).groupBy("key", "parent", F.col("h").alias("node")).agg(F.bool_or("filed").alias("filed"))
    # A node with several rests under one parent gets all of them under the key: more candidates, never fewer.
    return met.join(cut, ["parent", "node"]).select("key", "parent", "node", "filed", "rest")


def _perhaps(lines: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Lines whose hash may be among the wanted ones: a bitmap of fixed size is broadcast, and most others need not be shuffled."""
    slot = F.pmod("h", F.lit(bits).cast("long"))
    maps = wanted.select(F.floor(slot / 32768).alias("m"), (slot % 32768).alias("p")).groupBy("m").agg(F.bitmap_construct_agg("p").alias("bitmap"))  # bits / 32768 rows of 4 KB
    at = slot % 32768
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = lines.withColumn("m", F.floor(slot / 32768)).join(F.broadcast(maps), "m")
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int") + 1)
    return found.where(byte.bitwiseAND(bit) != 0).drop("m", "bitmap")


def _links(rows: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) between nodes of rows (key, s, t, tile, filed, node, line), which come together by (key, s, t)."""

    def pairs(table_: pa.Table):
        key = [table_.column(k).to_numpy() for k in ("key", "s", "t")]
        node, filed, tile = table_.column("node").to_numpy(), table_.column("filed").to_numpy(zero_copy_only=False).astype(bool), table_.column("tile").to_numpy()
        across = key[1] != key[2]
        n = len(node)
        found_i, found_j = [], []
        d = 1
        same = np.ones(n, bool)
        while d < n:
            same = same[: n - d] & (key[0][d:] == key[0][: n - d]) & (key[1][d:] == key[1][: n - d]) & (key[2][d:] == key[2][: n - d])
            if not same.any():
                break
            i = np.flatnonzero(same)
            j = i + d
            ok = (node[i] != node[j]) & (filed[i] | filed[j]) & (~across[i] | (tile[i] != tile[j]))
            found_i.append(i[ok])
            found_j.append(j[ok])
            d += 1
        return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64),) * 2

    def settle(part: pa.Table) -> pa.RecordBatch:
        node, lines = part.column("node").to_numpy(), part.column("line").to_pylist()
        i, j = pairs(part)
        names, index = np.unique(node, return_inverse=True)
        _, first = np.unique(np.minimum(index[i], index[j]) * len(names) + np.maximum(index[i], index[j]), return_index=True)
        i, j = i[first], j[first]
        forest = Forest(len(names))
        step = 1 << 15
        for k in range(0, len(i), step):
            # What is in one component already needs no comparison.
            open_ = forest.label[index[i[k : k + step]]] != forest.label[index[j[k : k + step]]]
            x, y = i[k : k + step][open_], j[k : k + step][open_]
            ok = verified(lines, x, y, threshold)
            forest.link(index[x[ok]], index[y[ok]])
        e = np.array(forest.edges, np.int64).reshape(-1, 2)
        u, v = names[e[:, 0]], names[e[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    def run(batches):
        """Cuts the sorted rows where a meeting ends, at about 4,000 rows: some 500,000 pairs at most."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 1 << 12:
                continue
            key = np.stack([held.column(k).to_numpy() for k in ("key", "s", "t")])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if len(ends):
                yield settle(held.slice(0, int(ends[-1])).combine_chunks())
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks())

    return rows.mapInArrow(run, "u long, v long").distinct()


def _second_hash(line: str | Column) -> Column:
    return F.xxhash64(F.lit("second"), line)


def _candidates(met: DataFrame, named: DataFrame, threshold: int, tile: int, large: int, scratch: Scratch) -> DataFrame:
    """Rows (key, s, t, tile, filed, node, line) of the meetings, large ones split by segments, or else into pairs of tiles."""
    found = None
    rows = scratch.save(met.join(named, "h").select("key", F.lit(0).cast("long").alias("parent"), "node", "filed", F.col("line").alias("rest")), "level_0")
    for level in range(1, SPLITS + 2):
        sizes = scratch.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > large), f"sizes_{level}")
        split = sizes.where("key % 2 = 0") if level <= SPLITS else sizes.where("false")
        split = scratch.save(split.select("key"), f"split_{level}")
        again = split.limit(1).count() > 0
        here = rows.join(split, "key", "left_anti") if again else rows
        tiles = sizes.select("key", F.ceil(F.col("m") / F.lit(tile)).cast("int").alias("tiles"))
        placed = here.join(tiles, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        dealt = placed.withColumn("other", other).select("key", F.least("tile", "other").alias("s"), F.greatest("tile", "other").alias("t"), "tile", "filed", "node", "rest")
        dealt = dealt.withColumnRenamed("rest", "line") if level == 1 else dealt.drop("rest").distinct().join(named.select("node", "line"), "node")
        dealt = dealt.select("key", "s", "t", "tile", "filed", "node", "line")
        found = dealt if found is None else found.union(dealt)
        if not again:
            return found
        rows = scratch.save(_split(rows.join(split, "key"), threshold, scratch, level), f"level_{level}")
    return found


def line_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: int = THRESHOLD, tile: int = TILE, large: int = LARGE, row_col: str | None = None) -> DataFrame:
    """Per row of docs: row, the id column, n_lines, dropped, copied_from.

    Lines are what \\n separates; those of spaces alone don't count and are never dropped. Of each class of linked lines
    the one that comes first, by id and then by place, stays. dropped has the places (from 0) of a document's other
    lines, copied_from the ids of the documents where their classes come first. Null text is one empty line. Null ids
    come after all others; repeated rows are documents of their own. row is row_col, a number of each row, or one given here.
    """
    spark = docs.sparkSession
    python_ready(spark)
    scratch = Scratch(spark, "line_dedup")
    lines = _lines(docs, text).select("line", F.xxhash64("line").alias("h"), _second_hash("line").alias("g"))
    met = _meetings(lines, threshold, scratch)
    wanted = scratch.save(met.select("h").distinct(), "wanted")
    # An inner join with distinct hashes: a semi join would be pushed below the filter.
    texts = _perhaps(lines, wanted).join(wanted, "h").select("line", "h", "g").distinct()
    named = scratch.save(texts.sortWithinPartitions("h", "g", "line").withColumn("node", F.monotonically_increasing_id()), "named")
    rows = _candidates(met, named, threshold, tile, large, scratch).repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "node")
    roots = components(_links(rows, threshold), scratch)
    ties = scratch.save(named.join(roots, named["node"] == roots["u"], "left").select("h", "g", F.coalesce("root", "node").alias("root")).dropDuplicates(["h", "g"]), "ties")
    real = F.length(F.trim("line")) > 0
    numbered = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"), F.col(id_col).alias("_id"), whole_text(text).alias("_t")).select("_row", "_id", F.posexplode(F.split("_t", "\n")).alias("pos", "line"))
    places = scratch.save(numbered.select("_row", "_id", "pos", real.alias("real"), F.xxhash64("line").alias("h"), _second_hash("line").alias("g")), "places")
    alone = F.col("root").isNull()
    classed = places.join(ties, ["h", "g"], "left").select("_row", "_id", "pos", "real", F.coalesce("root", F.lit(-1)).alias("root"), F.when(alone, F.col("h")).otherwise(0).alias("h"), F.when(alone, F.col("g")).otherwise(0).alias("g"))
    classed = scratch.save(classed, "classed")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("pos").alias("pos")))
    firsts = classed.where("real").groupBy("root", "h", "g").agg(first.alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    judged = classed.join(scratch.save(firsts, "firsts"), ["root", "h", "g"], "left")
    again = F.col("real") & F.col("first").isNotNull() & ~((F.col("first.row") == F.col("_row")) & (F.col("first.pos") == F.col("pos")))
    by_row = judged.groupBy("_row").agg(
        F.first("_id").alias(id_col), F.count_if("real").alias("n_lines"),
        F.array_sort(F.collect_list(F.when(again, F.col("pos")))).alias("dropped"), F.array_sort(F.collect_set(F.when(again, F.col("first.id")))).alias("copied_from"),
    )
    return by_row.withColumnRenamed("_row", "row")


def drop_repeated_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all their columns, with the text less the lines that line_classes drops. Ids may be null or repeat; a null text becomes empty."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_text, own_id = names[docs.columns.index(text)], names[docs.columns.index(id_col)]
    # Written first, so that a row keeps its number.
    rows = Scratch(docs.sparkSession, "line_dedup").save(docs.toDF(*names).withColumn("_at", F.monotonically_increasing_id()), "rows")
    found = line_classes(rows, own_text, own_id, row_col="_at", **how).select(F.col("row").alias("_at"), "dropped")
    kept = F.filter(F.transform(F.split(whole_text(own_text), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("dropped"), s["i"]))
    left = rows.join(found, "_at").withColumn("_left", F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return left.select(*[F.col("_left" if n == own_text else n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", "copied_from")
