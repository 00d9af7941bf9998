"""Trees: one tree is a small object that a task holds; many trees, alignments' columns and samples are rows.

Newick texts come in as a column. What concerns one tree (rooting, pruning, order of branches) maps texts to texts; what
compares trees goes through rows of clades, and likelihood and parsimony through rows of distinct column patterns, so
that a long alignment is spread over tasks and the tree travels to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandlake.operators.kernels import parse_newick, splits, tree_nodes


class Tree:
    """Nodes are numbers; children, name and length by number. The root has no parent."""

    def __init__(self, parent: list[int | None], name: list[str], length: list[float], children: list[list[int]] | None = None):
        self.parent, self.name, self.length = parent, name, length
        self.children = children or [[] for _ in parent]
        if children is None:
            for n, p in enumerate(parent):
                if p is not None:
                    self.children[p].append(n)

    @classmethod
    def parse(cls, text: str) -> Tree:
        nodes = parse_newick(text)
        return cls([n[1] for n in nodes], [n[2] for n in nodes], [n[3] or 0.0 for n in nodes])

    @property
    def root(self) -> int:
        return self.parent.index(None)

    def write(self, lengths: bool = True) -> str:
        done: dict[int, str] = {}
        for n in reversed(self.preorder()):
            inner = f"({','.join(done.pop(c) for c in self.children[n])})" if self.children[n] else ""
            tail = f":{self.length[n]:.6g}" if lengths and self.parent[n] is not None else ""
            done[n] = inner + self.name[n] + tail
        return done[self.root] + ";"

    def preorder(self, at: int | None = None) -> list[int]:
        out, todo = [], [self.root if at is None else at]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += reversed(self.children[n])
        return out

    def leaves(self, at: int | None = None) -> list[int]:
        return [n for n in self.preorder(at) if not self.children[n]]

    def leaf_names(self, at: int | None = None) -> list[str]:
        return [self.name[n] for n in self.leaves(at)]

    def find(self, name: str) -> int:
        return self.name.index(name)

    def path(self, node: int) -> list[int]:
        """From the root to the node, both included."""
        out = [node]
        while (p := self.parent[out[-1]]) is not None:
            out.append(p)
        return out[::-1]

    def trace(self, a: int, b: int) -> list[int]:
        """From a to b through their common ancestor."""
        p, q = self.path(a), self.path(b)
        k = sum(x == y for x, y in zip(p, q))
        return p[: k - 1 : -1] + q[k - 1 :]

    def common_ancestor(self, names: list[str]) -> int:
        paths = [self.path(self.find(n)) for n in names]
        return next(p for p in reversed(paths[0]) if all(p in q for q in paths))

    def is_parent_of(self, a: int, b: int) -> bool:
        return a in self.path(b)[:-1]

    def is_monophyletic(self, names: list[str]) -> bool:
        return set(self.leaf_names(self.common_ancestor(names))) == set(names)

    def is_bifurcating(self) -> bool:
        return all(len(c) in (0, 2) or (len(c) == 3 and n == self.root) for n, c in enumerate(self.children))

    def is_preterminal(self, node: int) -> bool:
        """Has children, all of them leaves."""
        return bool(self.children[node]) and all(not self.children[c] for c in self.children[node])

    def nonterminals(self) -> list[int]:
        return [n for n in self.preorder() if self.children[n]]

    def total_length(self) -> float:
        return sum(x for n, x in enumerate(self.length) if self.parent[n] is not None)

    def depths(self) -> list[float]:
        out = [0.0] * len(self.parent)
        for n in self.preorder()[1:]:
            out[n] = out[self.parent[n]] + self.length[n]
        return out

    def distance_matrix(self) -> tuple[list[str], np.ndarray]:
        """Leaf names and the lengths of the ways between them."""
        leaves, depth = self.leaves(), self.depths()
        paths = {n: set(self.path(n)) for n in leaves}
        out = np.zeros((len(leaves),) * 2)
        for i, a in enumerate(leaves):
            for j in range(i):
                top = max(depth[n] for n in paths[a] & paths[leaves[j]])
                out[i, j] = out[j, i] = depth[a] + depth[leaves[j]] - 2 * top
        return [self.name[n] for n in leaves], out

    def _rebuilt(self, children: dict[int, list[int]], root: int, length: dict[int, float]) -> Tree:
        """A tree of the nodes below root, in the order of children; inner nodes with one child are joined with it."""
        parent: list[int | None] = []
        name: list[str] = []
        lengths: list[float] = []
        todo = [(root, None, 0.0)]
        while todo:
            n, p, extra = todo.pop()
            kids = children.get(n, [])
            if len(kids) == 1:
                todo.append((kids[0], p, 0.0 if p is None else extra + length.get(n, 0.0)))
                continue
            parent.append(p)
            name.append(self.name[n] if n < len(self.name) else "")
            lengths.append(0.0 if p is None else extra + length.get(n, 0.0))
            me = len(parent) - 1
            todo += [(c, me, 0.0) for c in reversed(kids)]
        return Tree(parent, name, lengths)

    def ladderize(self) -> Tree:
        """Branches with fewer leaves first; of equal ones, by their smallest leaf name."""
        key = {n: (len(x := self.leaf_names(n)), min(x)) for n in range(len(self.parent))}
        return self._rebuilt({n: sorted(c, key=key.__getitem__) for n, c in enumerate(self.children)}, self.root, dict(enumerate(self.length)))

    def prune(self, names: list[str]) -> Tree:
        """Without the leaves of these names; branches left without leaves go as well."""
        gone = set(names)
        kept = {n: any(x not in gone for x in self.leaf_names(n)) for n in range(len(self.parent))}
        return self._rebuilt({n: [c for c in kids if kept[c]] for n, kids in enumerate(self.children)}, self.root, dict(enumerate(self.length)))

    def collapse(self, shortest: float) -> Tree:
        """Inner branches shorter than this are taken out; their children hang one node higher, as far away as before."""
        length = dict(enumerate(self.length))

        def below(n: int) -> list[int]:
            out = []
            for c in self.children[n]:
                if self.children[c] and self.length[c] < shortest:
                    inner = below(c)
                    for x in inner:
                        length[x] = length[x] + self.length[c]
                    out += inner
                else:
                    out.append(c)
            return out

        return self._rebuilt({n: below(n) for n in sorted(range(len(self.parent)), key=lambda n: len(self.path(n))) if n == self.root or not (self.children[n] and self.length[n] < shortest)}, self.root, length)

    def rooted_above(self, node: int, share: float = 0.5) -> Tree:
        """With the root on the branch above a node, share of its length away from the node."""
        if self.parent[node] is None:
            return self
        way = self.path(node)[::-1]  # node, its parent, ... the root
        children = {n: list(c) for n, c in enumerate(self.children)}
        length = dict(enumerate(self.length))
        new = len(self.parent)
        for a, b in zip(way, way[1:]):
            children[b].remove(a)
        for a, b in zip(way[1:], way[2:]):
            children[a].append(b)
        for a, b in zip(way[2:], way[1:]):
            length[a] = self.length[b]
        children[new] = [node, way[1]]
        length[node], length[way[1]] = self.length[node] * share, self.length[node] * (1 - share)
        return self._rebuilt(children, new, length)

    def root_with_outgroup(self, names: list[str]) -> Tree:
        return self.rooted_above(self.common_ancestor(names))

    def midpoint_root(self) -> Tree:
        """The root half way between the two leaves furthest apart."""
        names, d = self.distance_matrix()
        i, j = sorted(divmod(int(d.argmax()), len(names)))
        depth = self.depths()
        a, b = self.find(names[i]), self.find(names[j])
        if depth[a] < depth[b]:
            a, b = b, a
        rest = d[i, j] / 2
        while rest > self.length[a] and self.parent[a] is not None:
            rest -= self.length[a]
            a = self.parent[a]
        return self.rooted_above(a, rest / self.length[a]) if self.parent[a] is not None and self.length[a] else self

    def to_nexus(self, label: str = "tree") -> str:
        names = ";".join(self.leaf_names()).replace(";", " ")
        return f"#NEXUS\nBEGIN TAXA;\nDIMENSIONS NTAX={len(self.leaves())};\nTAXLABELS {names};\nEND;\nBEGIN TREES;\nTREE {label} = {self.write()}\nEND;\n"


def upgma(names: list[str], distances: np.ndarray) -> str:
    """Newick text of average linkage, the least distance first; branch lengths are differences of heights."""
    d = np.array(distances, float)
    np.fill_diagonal(d, np.inf)
    label, height, size = list(names), [0.0] * len(names), [1] * len(names)
    while len(label) > 1:
        i, j = sorted(divmod(int(d.argmin()), len(label)))
        h = d[i, j] / 2
        text = f"({label[i]}:{h - height[i]:.6g},{label[j]}:{h - height[j]:.6g})"
        mean = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        keep = [k for k in range(len(label)) if k not in (i, j)]
        d = np.vstack([np.column_stack([d[np.ix_(keep, keep)], mean[keep]]), np.append(mean[keep], np.inf)])
        label, height, size = ([x[k] for k in keep] + [new] for x, new in ((label, text), (height, h), (size, size[i] + size[j])))
    return label[0] + ";"


def transition_probability(t: float | np.ndarray) -> tuple:
    """Under equal rates of all changes: of no change and of one certain change along a branch of length t."""
    e = np.exp(-4 * np.asarray(t) / 3)
    return 0.25 + 0.75 * e, 0.25 - 0.25 * e


def map_trees(newick: Column, what: Callable[[Tree], Tree]) -> Column:
    """A Newick column from another, tree by tree."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else what(Tree.parse(t)).write()), StringType())(newick)


def tree_summary(trees: DataFrame, key: str = "tree_id", text: str = "newick") -> DataFrame:
    """Leaves, inner nodes, whether all of these have two children, length and depth of each tree; from its node rows."""
    nodes = tree_nodes(trees, key, text)
    kids = nodes.where("parent is not null").groupBy(key, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    rows = nodes.join(kids, [key, "node"], "left")
    two = F.when(F.col("parent").isNull(), F.col("k").isin(2, 3)).otherwise(F.col("k") == 2)
    return rows.groupBy(key).agg(
        F.count_if(F.col("k").isNull()).alias("leaves"), F.count("k").alias("inner"), F.bool_and(F.col("k").isNull() | two).alias("bifurcating"),
        F.sum(F.when(F.col("parent").isNotNull(), F.coalesce("length", F.lit(0.0))).otherwise(0.0)).alias("length"),
    )


def leaf_distances(trees: DataFrame, key: str = "tree_id", text: str = "newick") -> DataFrame:
    """(key, a, b, distance) for the leaves a < b of each tree."""
    kind = trees.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text], strict=True):
                names, d = Tree.parse(t).distance_matrix()
                rows += [(k, *sorted((names[i], names[j])), d[i, j]) for i in range(len(names)) for j in range(i)]
            yield pd.DataFrame(rows, columns=[key, "a", "b", "distance"])

    return trees.select(key, text).mapInPandas(run, f"{key} {kind}, a string, b string, distance double")


def clade_support(trees: DataFrame, key: str = "tree_id", text: str = "newick") -> DataFrame:
    """(leaves, trees, share): how many trees have each clade, and the share of all."""
    clades = splits(tree_nodes(trees, key, text), key).select(key, "leaves").distinct()
    total = F.broadcast(trees.agg(F.count_distinct(key).alias("_all")))  # one row
    return clades.groupBy("leaves").agg(F.count(F.lit(1)).alias("trees")).crossJoin(total).select("leaves", "trees", (F.col("trees") / F.col("_all")).alias("share"))


def consensus_tree(trees: DataFrame, share: float = 0.5, key: str = "tree_id", text: str = "newick") -> str:
    """Clades that more than a share of the trees have (all of them if share is 1), as a tree; shares stand as inner names.

    More than half the trees agree on few clades: no more than a tree has. Only those come to the driver.
    """
    found = clade_support(trees, key, text).where(F.col("share") > share if share < 1 else F.col("share") == 1).collect()
    leaves = sorted(Tree.parse(trees.select(text).first()[0]).leaf_names())
    clades = sorted(({frozenset(r["leaves"]): r["share"] for r in found} | {frozenset(leaves): 1.0}).items(), key=lambda x: (-len(x[0]), sorted(x[0])))
    clades = [c for k, c in enumerate(clades) if all(c[0] <= d[0] or not c[0] & d[0] for d in clades[:k])]
    parent: list[int | None] = [None]
    name, sets = [""], [clades[0][0]]
    for c, s in clades[1:]:
        parent.append(max((k for k, x in enumerate(sets) if c < x), key=lambda k: -len(sets[k])))
        name.append(f"{s:.3g}")
        sets.append(c)
    for x in leaves:
        parent.append(min((k for k in range(len(clades)) if x in sets[k]), key=lambda k: len(sets[k])))
        name.append(x)
        sets.append(frozenset([x]))
    return Tree(parent, name, [0.0] * len(parent)).write(lengths=False)


def strict_consensus(trees: DataFrame, **how) -> str:
    return consensus_tree(trees, 1.0, **how)


def bootstrap_support(reference: str, trees: DataFrame, key: str = "tree_id", text: str = "newick") -> DataFrame:
    """(leaves, share) of each inner clade of the reference tree: the share of the trees that have it."""
    spark = trees.sparkSession
    own = splits(tree_nodes(spark.createDataFrame([(0, reference)], "tree_id int, newick string")), "tree_id").select("leaves")
    return own.join(clade_support(trees, key, text), "leaves", "left").select("leaves", F.coalesce("share", F.lit(0.0)).alias("share"))


def bootstrap_columns(columns: DataFrame, replicates: int, pos: str = "pos", seed: int = 1) -> DataFrame:
    """(replicate, slot, columns of `columns`): each replicate draws as many columns as there are, with replacement, by a hash."""
    total = F.broadcast(columns.agg(F.max(pos).alias("_n")))  # one row
    slots = columns.select(F.col(pos).alias("slot")).crossJoin(total).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = slots.select("replicate", "slot", (F.pmod(F.xxhash64(F.lit(seed), "replicate", "slot"), F.col("_n")) + 1).alias(pos))
    return drawn.join(columns, pos)


def patterns(alignment: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """(pattern, n): the letters of a column, by ascending name, and how many columns have them. Rows are of one length."""
    letters = alignment.select(F.col(name).alias("_name"), F.posexplode(F.split(seq, "")).alias("pos", "letter"))
    by_column = letters.groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_name", "letter"))), lambda s: s["letter"]), "").alias("pattern"))  # a letter a sequence
    return by_column.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def _by_pattern(rows: DataFrame, tree: Tree, score: Callable[[Tree, np.ndarray], np.ndarray]) -> DataFrame:
    order = sorted(tree.leaf_names())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            letters = np.array([list(p) for p in f["pattern"]]).reshape(len(f), len(order))
            yield f.assign(score=score(tree, letters).astype(float))[["pattern", "n", "score"]]

    return rows.mapInPandas(run, "pattern string, n long, score double")


def parsimony(rows: DataFrame, newick: str) -> DataFrame:
    """(pattern, n, score): the least number of changes on a bifurcating tree that explains each pattern; letters other than ACGT may be any."""

    def score(tree: Tree, letters: np.ndarray) -> np.ndarray:
        at = {n: k for k, n in enumerate(sorted(tree.leaf_names()))}
        changes = np.zeros(len(letters), int)
        sets: dict[int, np.ndarray] = {}
        for n in reversed(tree.preorder()):
            if not tree.children[n]:
                column = letters[:, at[tree.name[n]]]
                bits = sum(((column == b).astype(int) << k for k, b in enumerate("ACGT")), np.zeros(len(letters), int))
                sets[n] = np.where(bits == 0, 15, bits)
                continue
            now = sets[tree.children[n][0]]
            for c in tree.children[n][1:]:
                both = now & sets[c]
                changes += both == 0
                now = np.where(both == 0, now | sets[c], both)
            sets[n] = now
        return changes

    return _by_pattern(rows, Tree.parse(newick), score)


def likelihood(rows: DataFrame, newick: str) -> DataFrame:
    """(pattern, n, score): the log likelihood of each pattern under equal rates of change; letters other than ACGT may be any."""

    def score(tree: Tree, letters: np.ndarray) -> np.ndarray:
        at = {n: k for k, n in enumerate(sorted(tree.leaf_names()))}
        part: dict[int, np.ndarray] = {}
        for n in reversed(tree.preorder()):
            if not tree.children[n]:
                known = np.stack([letters[:, at[tree.name[n]]] == b for b in "ACGT"], 1).astype(float)
                part[n] = np.where(known.any(1, keepdims=True), known, 1.0)
                continue
            part[n] = np.ones((len(letters), 4))
            for c in tree.children[n]:
                same, other = transition_probability(tree.length[c])
                part[n] *= part[c] @ (np.full((4, 4), other) + np.eye(4) * (same - other))
        return np.log(part[tree.root].mean(1))

    return _by_pattern(rows, Tree.parse(newick), score)


def total_score(scored: DataFrame) -> float:
    return scored.agg(F.sum(F.col("n") * F.col("score"))).first()[0] or 0.0


# --- communities on a tree: paths has (leaf, node, length), a row for each branch above a leaf, its own included ---------


def tree_paths(trees: DataFrame, text: str = "newick") -> DataFrame:
    """(leaf, node, length) of the one tree in the table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for t in map(Tree.parse, f[text]):
                yield pd.DataFrame([(t.name[x], str(n), t.length[n]) for x in t.leaves() for n in t.path(x)[1:]], columns=["leaf", "node", "length"])

    return trees.select(text).mapInPandas(run, "leaf string, node string, length double")


def branch_shares(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """(sample, node, length, share): the share of a sample's counts (sample, leaf, n) that lies under each branch."""
    total = counts.groupBy("sample").agg(F.sum("n").alias("_t"))
    under = counts.where("n > 0").join(paths, "leaf").groupBy("sample", "node", "length").agg(F.sum("n").alias("_n"))
    return under.join(total, "sample").select("sample", "node", "length", (F.col("_n") / F.col("_t")).alias("share"))


def faith_pd(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """The length of all branches that a sample's leaves hang on."""
    return branch_shares(counts, paths).groupBy("sample").agg(F.sum("length").alias("pd"))


def unifrac(counts: DataFrame, paths: DataFrame, weighted: bool = False) -> DataFrame:
    """(a, b, distance) for samples a < b.

    Unweighted: the length of branches that only one of the two has, over that of either's. Weighted: the sum of length
    times the difference of shares over the length of all branches. Only branches that both have are joined; the rest
    follows from each sample's own sums.
    """
    s = branch_shares(counts, paths)
    value = F.col("length") * F.col("share") if weighted else F.col("length")
    own = s.groupBy("sample").agg(F.sum(value).alias("own"))
    left, right = (s.select(F.col("sample").alias(x), "node", "length", F.col("share").alias(f"s_{x}")) for x in "ab")
    least = F.col("length") * F.least("s_a", "s_b") if weighted else F.col("length")
    both = left.join(right, ["node", "length"]).where("a < b").groupBy("a", "b").agg(F.sum(least).alias("both"))
    pairs = own.toDF("a", "own_a").join(own.toDF("b", "own_b"), F.col("a") < F.col("b"))  # a row for each pair is the result
    pairs = pairs.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0.0)))
    apart = F.col("own_a") + F.col("own_b") - 2 * F.col("both")
    if weighted:
        whole = F.broadcast(paths.select("node", "length").distinct().agg(F.sum("length").alias("_all")))  # one row
        return pairs.crossJoin(whole).select("a", "b", (apart / F.col("_all")).alias("distance"))
    return pairs.select("a", "b", (apart / (apart + F.col("both"))).alias("distance"))


def principal_coordinates(names: list[str], distances: np.ndarray, dimensions: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates whose distances are those given as nearly as may be, and each axis' share of the variance."""
    d = np.asarray(distances, float)
    n = len(names)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ d**2 @ centre)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(n)] < 0, -1, 1)
    return (vectors * np.sqrt(values))[:, :dimensions], values[:dimensions] / (values.sum() or math.inf)
