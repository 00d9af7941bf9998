import random

import pytest

from strandlake.llm.line_dedup import _met, drop_repeated_lines, keys_of, line_classes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, threshold):
    places = sorted(((d is None, d or 0, k), p, line) for k, (d, t) in enumerate(docs) for p, line in enumerate((t or "").split("\n")) if line.strip(" "))
    texts = sorted({line for _, _, line in places})
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                root[find(b)] = find(a)
    seen, out = {}, {}
    for (none, d, k), p, line in places:
        c = find(line)
        if c in seen:
            out.setdefault(k, ([], set()))
            out[k][0].append(p)
            out[k][1].add(seen[c])
        else:
            seen[c] = None if none else d
    return out


def compare(spark, docs, **how):
    df = spark.createDataFrame([(a, b, "h") for a, b in docs], "doc_id long, text string, h string")
    got = line_classes(df, **how).collect()
    assert len(got) == len(docs)
    want = brute(docs, 2)
    by_id = {x["doc_id"]: x for x in got if x["doc_id"] is not None}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            dropped, came = want.get(k, ([], set()))
            assert by_id[d]["dropped"] == dropped and set(by_id[d]["copied_from"]) == {c for c in came if c is not None}, d
    assert sum(len(x["dropped"]) for x in got) == sum(len(x[0]) for x in want.values())


def edited(r, line, n):
    x = list(line)
    for _ in range(n):
        k = r.randrange(len(x))
        x[k : k + 1] = r.choice([[], [r.choice("xyz")], [x[k], r.choice("xyz")]])
        x = x or ["q"]
    return "".join(x)


@pytest.mark.parametrize("how", [{"tile": 4, "large": 6}, {"tile": 4, "large": 1000}, {}])
def test_equals_brute_force(spark, how):
    r = random.Random(5)
    base = ["".join(r.choices("abcdé ", k=r.randint(18, 60))) for _ in range(12)]
    docs = [(i, "\n".join([*(edited(r, r.choice(base), r.randint(0, 3)) for _ in range(r.randint(0, 5))), "", "short", " "])) for i in range(60)]
    docs += [(100, None), (None, base[0]), (None, base[0]), (101, "")]
    compare(spark, docs, **how)


@pytest.mark.parametrize("how", [{"tile": 4, "large": 6}, {}])
def test_lines_that_share_a_segment_are_split_again(spark, how):
    r = random.Random(6)
    base = ["the very same beginning of many lines " + "".join(r.choices("abcdefgh ", k=r.randint(10, 70))) for _ in range(40)]
    docs = [(i, "\n".join(edited(r, r.choice(base), r.randint(0, 3)) for _ in range(3))) for i in range(60)]
    compare(spark, docs, **how)


@pytest.mark.parametrize("how", [{"tile": 4, "large": 6}, {}])
def test_short_lines(spark, how):
    r = random.Random(7)
    letters = "".join(chr(0x4E00 + k) for k in range(60))
    docs = [(i, "\n".join("".join(r.choices(letters, k=r.choice([1, 2, 3, 3, 4, 4, 5, 6, 7, 9]))) for _ in range(2))) for i in range(60)]
    compare(spark, docs, **how)


def test_keys_of_all_pairs_of_short_lines():
    """Any two lines within the threshold have a key in common that one of them is filed under."""
    import itertools

    import numpy as np

    lines = ["".join(x) for n in range(1, 6) for x in itertools.product("abc", repeat=n)]
    for t in (1, 2, 3):
        who, key, filed, _, _ = keys_of(lines, t)
        own = [dict(zip(key[who == k].tolist(), filed[who == k].tolist())) for k in range(len(lines))]
        filed_of = [set(key[(who == k) & filed].tolist()) for k in range(len(lines))]
        r = np.random.default_rng(t)
        for i, j in r.integers(0, len(lines), (4000, 2)).tolist():
            if distance(lines[i], lines[j]) <= t:
                assert filed_of[i] & own[j].keys() or filed_of[j] & own[i].keys(), (lines[i], lines[j], t)


def test_met_in_small_batches(spark):
    """Keys that go on over many batches, and keys that nothing is filed under."""
    r = random.Random(8)
    rows = [(k, 0, r.randrange(3) if k % 5 else 7, k % 3 > 0 and r.random() < 0.3) for k in range(40) for _ in range(r.choice([1, 3, 400]))]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = set(map(tuple, _met(spark.createDataFrame(rows, "key long, parent long, h long, filed boolean")).distinct().collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    good = {k for k in range(40) if any(x[3] for x in rows if x[0] == k) and len({x[2] for x in rows if x[0] == k}) > 1}
    assert got == {x for x in rows if x[0] in good}


def test_drops_lines_from_texts(spark):
    docs = [(1, "the very same long line here\nown line number one, quite long", "a"), (2, "the very same long line hare\nown text number two, as long", "b"), (None, None, "c"), (2, "a third text that is far from all others", None), (None, "what a null id says stays as well", "d")]
    out = sorted(map(tuple, drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string, dropped string")).collect()), key=str)
    want = [docs[0], (2, "own text number two, as long", "b"), (None, "", "c"), docs[3], docs[4]]
    assert out == sorted(want, key=str)


def test_long_lines(spark):
    line = "x y z " * 20000
    got = {x["doc_id"]: x["dropped"] for x in line_classes(spark.createDataFrame([(1, line), (2, line[:-9] + line[-8:]), (3, line[::-1])], "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: []}


def test_empty(spark):
    assert line_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
