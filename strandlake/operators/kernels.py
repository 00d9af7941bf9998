"""Dynamic programs and trees that relational operators don't express, as Arrow-batched functions over rows or small groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def align_score(a: str, b: str, match: float = 2, mismatch: float = -1, gap_open: float = -2, gap_extend: float = -0.5, local: bool = False) -> float:
    """Affine-gap alignment score, global or local. Rows are vectors; horizontal gaps are a running maximum."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    n = len(y)
    steps = np.arange(n + 1) * gap_extend
    best = np.where(np.arange(n + 1) == 0, 0.0, gap_open + steps - gap_extend)
    if local:
        best = np.zeros(n + 1)
    down = np.full(n + 1, -np.inf)
    top = 0.0
    for i in range(1, len(x) + 1):
        down = np.maximum(down + gap_extend, best + gap_open)
        here = np.empty(n + 1)
        here[0] = 0.0 if local else gap_open + (i - 1) * gap_extend
        here[1:] = np.maximum(best[:-1] + np.where(y == x[i - 1], match, mismatch), down[1:])
        if local:
            here = np.maximum(here, 0)
        # A gap that opens at k and ends at j costs gap_open + (j - k - 1) * gap_extend. A gap need not follow a gap.
        reach = np.maximum.accumulate(here - steps)[:-1] + gap_open - gap_extend + steps[1:]
        here[1:] = np.maximum(here[1:], reach)
        best = here
        top = max(top, float(best.max()))
    return top if local else float(best[-1])


def alignment(a: Column, b: Column, **scoring) -> Column:
    return F.pandas_udf(lambda s, t: pd.Series([align_score(x, y, **scoring) for x, y in zip(s, t, strict=True)], dtype=float), DoubleType())(a, b)


def viterbi(symbols: str, start: list[float], move: list[list[float]], emit: list[dict[str, float]]) -> str:
    """The likeliest states, as digits; all probabilities as logarithms."""
    if not symbols:
        return ""
    t = np.array(move)
    lowest = -1e9
    e = lambda c: np.array([d.get(c, lowest) for d in emit])
    v, back = np.array(start) + e(symbols[0]), []
    for c in symbols[1:]:
        w = v[:, None] + t
        back.append(w.argmax(0))
        v = w.max(0) + e(c)
    path = [int(v.argmax())]
    for k in reversed(back):
        path.append(int(k[path[-1]]))
    return "".join(map(str, reversed(path)))


def hidden_states(symbols: Column, start, move, emit) -> Column:
    return F.pandas_udf(lambda s: pd.Series([viterbi(x, start, move, emit) for x in s]), StringType())(symbols)


def parse_newick(text: str) -> list[tuple[int, int | None, str, float | None]]:
    """Nodes (number, parent's number, name, branch length), the root first."""
    nodes: list[list] = [[0, None, "", None]]
    at = 0
    for token in re.findall(r"[(),;]|:[^(),;:]+|'[^']*'|[^(),;:]+", text.strip()):
        if token == "(":
            nodes.append([len(nodes), at, "", None])
            at = len(nodes) - 1
        elif token == ",":
            nodes.append([len(nodes), nodes[at][1], "", None])
            at = len(nodes) - 1
        elif token == ")":
            at = nodes[at][1]
        elif token[0] == ":":
            nodes[at][3] = float(token[1:])
        elif token != ";" and token.strip():
            nodes[at][2] = token.strip().strip("'")
    return [tuple(n) for n in nodes]


def tree_nodes(trees: DataFrame, key: str = "tree_id", text: str = "newick") -> DataFrame:
    """A row for each node of each tree: tree_id, node, parent, name, length."""
    kind = trees.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *n) for k, t in zip(f[key], f[text], strict=True) for n in parse_newick(t)]
            yield pd.DataFrame(rows, columns=[key, "node", "parent", "name", "length"]).astype({"parent": "Int64"})

    return trees.select(key, text).mapInPandas(run, f"{key} {kind}, node long, parent long, name string, length double")


def splits(nodes: DataFrame, key: str = "tree_id") -> DataFrame:
    """The set of leaf names under each inner node but the root, of each tree, as a sorted array."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        parent = dict(zip(f.node, f.parent, strict=True))
        inner = {p for p in f.parent.dropna()}
        under: dict = {n: [] for n in inner}
        for n, name in zip(f.node, f.name, strict=True):
            if n in inner:
                continue
            p = parent[n]
            while pd.notna(p):
                under[p].append(name)
                p = parent[p]
        rows = [(f[key].iloc[0], sorted(v)) for n, v in under.items() if pd.notna(parent[n])]
        return pd.DataFrame(rows, columns=[key, "leaves"])

    kind = nodes.schema[key].dataType.simpleString()
    return nodes.groupBy(key).applyInPandas(run, f"{key} {kind}, leaves array<string>")


def robinson_foulds(split_rows: DataFrame, key: str = "tree_id") -> DataFrame:
    """Splits that only one tree of a pair has, for each pair of trees."""
    s = split_rows.select(key, "leaves").distinct()
    size = s.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = s.select(F.col(key).alias("a"), "leaves").join(s.select(F.col(key).alias("b"), "leaves"), "leaves").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    pairs = size.toDF("a", "na").join(size.toDF("b", "nb"), F.col("a") < F.col("b"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (F.col("na") + F.col("nb") - 2 * F.coalesce("m", F.lit(0))).alias("distance"))


def neighbor_joining(names: list[str], distances: np.ndarray) -> str:
    """Newick text of the tree that joins the pair of least corrected distance again and again."""
    d = np.array(distances, float)
    labels = list(names)
    while len(labels) > 2:
        n = len(labels)
        r = d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(q.argmin()), n)
        i, j = min(i, j), max(i, j)
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        new = (d[i] + d[j] - d[i, j]) / 2
        label = f"({labels[i]}:{li:.6g},{labels[j]}:{d[i, j] - li:.6g})"
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.vstack([np.column_stack([d[np.ix_(keep, keep)], new[keep]]), np.append(new[keep], 0.0)])
        labels = [labels[k] for k in keep] + [label]
    return f"({labels[0]}:{d[0, 1]:.6g},{labels[1]}:0);" if len(labels) == 2 else f"{labels[0]};"


def superpose(moving: np.ndarray, fixed: np.ndarray) -> float:
    """Root mean square deviation after the best rotation and shift of one set of points onto the other."""
    a, b = moving - moving.mean(0), fixed - fixed.mean(0)
    u, s, v = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u) * np.linalg.det(v)) or 1.0
    return float(np.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))))


def k_nearest(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int, rows: int = 16384) -> DataFrame:
    """The k nearest other points of each query (Euclidean), exactly; of equal distances the smaller key is nearer.

    Points and queries are dealt into tiles of about `rows`, and each tile of points meets each tile of queries in one
    group; its k best candidates a query go on, and the best k of all stay. So neither side has to fit a task or the
    driver; the work stays points times queries. Rows with a null key or vector take no part.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    known = [df.select(F.col(key).alias("_id"), F.col(vector).alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull()) for df in (points, queries)]
    width = points.sparkSession.sparkContext.defaultParallelism
    n_p, n_q = max(-(-known[0].count() // rows), width), max(-(-known[1].count() // rows), 1)
    kind = points.schema[key].dataType.simpleString()

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("_id", "_v"), F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(p) and len(q):
            p = p.sort_values("_id")
            ids, at = p["_id"].to_numpy(), np.stack(p["_v"].map(np.asarray)).astype(np.float64)
            q_ids, q_at = q["_id"].to_numpy(), np.stack(q["_v"].map(np.asarray)).astype(np.float64)
            step, m = max(1, 4_000_000 // max(1, at.size)), min(k, len(p))
            for i in range(0, len(q), step):
                d = ((q_at[i : i + step, None, :] - at[None, :, :]) ** 2).sum(2)
                d[q_ids[i : i + step, None] == ids[None, :]] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :m]
                found.append(pd.DataFrame({"query": np.repeat(q_ids[i : i + step], m), "point": ids[best].reshape(-1), "distance": np.sqrt(np.take_along_axis(d, best, 1)).reshape(-1)}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "point": [], "distance": []})

    tiles = [dealt(known[0], "_p", n_p, "_q", n_q).groupBy("_p", "_q"), dealt(known[1], "_q", n_q, "_p", n_p).groupBy("_p", "_q")]
    found = tiles[0].cogroup(tiles[1]).applyInPandas(run, f"query {kind}, point {kind}, distance double").where(F.col("distance") < float("inf"))
    nearest = Window.partitionBy("query").orderBy("distance", "point")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query", "rank", "point", "distance")
