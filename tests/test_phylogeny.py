import itertools
import math
import random

import numpy as np
import pytest

from strandlake.operators import phylogeny as ph
from strandlake.operators.phylogeny import Tree

TEXT = "((A:1,B:2):3,((C:1,D:1):2,E:5):1,F:4);"


def same_distances(a, b):
    (n, d), (m, e) = a.distance_matrix(), b.distance_matrix()
    k = [m.index(x) for x in n]
    return sorted(n) == sorted(m) and np.allclose(d, e[np.ix_(k, k)])


def test_tree_questions():
    t = Tree.parse(TEXT)
    assert t.write() == TEXT and t.total_length() == 20 and t.is_bifurcating()
    top = t.common_ancestor(["C", "E"])
    assert sorted(t.leaf_names(top)) == ["C", "D", "E"] and t.is_monophyletic(["C", "D", "E"]) and not t.is_monophyletic(["A", "C"])
    assert t.is_preterminal(t.common_ancestor(["C", "D"])) and not t.is_preterminal(top) and t.is_parent_of(top, t.find("D")) and not t.is_parent_of(top, t.find("A"))
    assert [t.name[n] for n in t.trace(t.find("A"), t.find("B"))] == ["A", "", "B"] and len(t.path(t.find("C"))) == 4 and len(t.nonterminals()) == 4
    names, d = t.distance_matrix()
    assert d[names.index("A"), names.index("C")] == 1 + 3 + 1 + 2 + 1 and d[names.index("E"), names.index("D")] == 8


def test_changed_trees_keep_their_distances():
    t = Tree.parse(TEXT)
    rooted = t.root_with_outgroup(["C", "D"])
    assert same_distances(t, rooted) and sorted(sorted(rooted.leaf_names(c)) for c in rooted.children[rooted.root]) == [["A", "B", "E", "F"], ["C", "D"]]
    mid = t.midpoint_root()
    assert same_distances(t, mid)
    depth = mid.depths()
    deepest = sorted((max(depth[n] for n in mid.leaves(c)) for c in mid.children[mid.root]), reverse=True)
    assert deepest[0] == pytest.approx(mid.distance_matrix()[1].max() / 2) == pytest.approx(deepest[1])
    assert [sorted(t.ladderize().leaf_names(c)) for c in t.ladderize().children[0]] == [["F"], ["A", "B"], ["C", "D", "E"]]
    pruned = t.prune(["D", "F"])
    assert sorted(pruned.leaf_names()) == ["A", "B", "C", "E"] and all(len(c) != 1 for c in pruned.children)
    k, j = t.distance_matrix(), pruned.distance_matrix()
    assert all(j[1][j[0].index(x), j[0].index(y)] == k[1][k[0].index(x), k[0].index(y)] for x, y in itertools.combinations("ABCE", 2))
    flat = t.collapse(2.5)
    assert len(flat.children[flat.root]) == 5 and flat.depths()[flat.find("C")] == 4
    assert "TREE x = ((A:1" in t.to_nexus("x")


def test_upgma():
    names, d = ["a", "b", "c", "d"], np.array([[0, 2, 6, 10], [2, 0, 6, 10], [6, 6, 0, 10], [10, 10, 10, 0]], float)
    t = Tree.parse(ph.upgma(names, d))
    n, e = t.distance_matrix()
    k = [n.index(x) for x in names]
    assert np.allclose(e[np.ix_(k, k)], d)


def brute_changes(tree, letters):
    """The least over all letters of inner nodes."""
    inner = tree.nonterminals()
    best = 99
    for states in itertools.product("ACGT", repeat=len(inner)):
        s = dict(zip(inner, states)) | {n: letters[tree.name[n]] for n in tree.leaves()}
        best = min(best, sum(s[n] != s[p] for n, p in enumerate(tree.parent) if p is not None))
    return best


def brute_likelihood(tree, letters):
    inner, total = tree.nonterminals(), 0.0
    for states in itertools.product("ACGT", repeat=len(inner)):
        s = dict(zip(inner, states)) | {n: letters[tree.name[n]] for n in tree.leaves()}
        x = 0.25
        for n, p in enumerate(tree.parent):
            if p is not None:
                same, other = ph.transition_probability(tree.length[n])
                x *= same if s[n] == s[p] else other
        total += x
    return math.log(total)


def test_parsimony_and_likelihood_equal_brute_force(spark):
    text = "((A:0.1,B:0.2):0.3,((C:0.1,D:0.15):0.2,E:0.5):0.1);"
    tree, r = Tree.parse(text), random.Random(2)
    seqs = {n: "".join(r.choices("ACGT", k=25)) for n in "ABCDE"}
    rows = ph.patterns(spark.createDataFrame(list(seqs.items()), "name string, seq string"))
    columns = [{n: s[k] for n, s in seqs.items()} for k in range(25)]
    assert ph.total_score(ph.parsimony(rows, text)) == sum(brute_changes(tree, c) for c in columns)
    assert ph.total_score(ph.likelihood(rows, text)) == pytest.approx(sum(brute_likelihood(tree, c) for c in columns))


def test_consensus_and_support(spark):
    texts = ["((A,B),(C,D),E);", "((A,B),(C,E),D);", "((A,B),((C,D),E));"]
    trees = spark.createDataFrame(list(enumerate(texts)), "tree_id int, newick string")
    t = Tree.parse(ph.consensus_tree(trees))
    assert {frozenset(t.leaf_names(n)) for n in t.nonterminals()} == {frozenset("ABCDE"), frozenset("AB"), frozenset("CD")}
    assert {frozenset(Tree.parse(ph.strict_consensus(trees)).leaf_names(n)) for n in Tree.parse(ph.strict_consensus(trees)).nonterminals()} >= {frozenset("AB")}
    assert {"".join(r["leaves"]): round(r["share"], 3) for r in ph.bootstrap_support(texts[0], trees).collect()} == {"AB": 1.0, "CD": 0.667}
    columns = spark.createDataFrame([(k, f"p{k}") for k in range(1, 21)], "pos int, pattern string")
    drawn = ph.bootstrap_columns(columns, 3).collect()
    assert len(drawn) == 60 and {r["replicate"] for r in drawn} == {1, 2, 3} and all(r["pattern"] == f"p{r['pos']}" for r in drawn)


def test_principal_coordinates(spark):
    r = np.random.default_rng(1)
    points = r.normal(size=(12, 2))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    found, share = ph.principal_coordinates(list(map(str, range(12))), d)
    assert np.allclose(np.sqrt(((found[:, None] - found[None]) ** 2).sum(2)), d) and share.sum() == pytest.approx(1)
    paths = ph.tree_paths(spark.createDataFrame([(TEXT,)], "newick string")).toPandas()
    assert paths.groupby("leaf").length.sum().to_dict() == {"A": 4, "B": 5, "C": 4, "D": 4, "E": 6, "F": 4}
