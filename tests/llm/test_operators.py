"""Each operator against a brute-force version, on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from strandlake.llm import exact_dedup, packing, pipeline, quality_net, quality_rules, simhash, token_files, tokens
from strandlake.llm.html_text import extract

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "The quick brown fox jumps over the lazy dog and the cat that is in the house of the man.", "the QUICK brown fox jumps over the lazy dog and the cat that is in the house of the man.",
    None, "", " \n\t", "É é", "é é", "x" * 9000, ("word " * 3000).strip(), "ab1 " * 5000, "a<|endoftext|>b", "日本語🙂 text\x0b\x1cmixed", "<|endof" + "text|>" * 3,
    "The quick brown fox jumps over the lazy dog and the cat that is in the house of the woman.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, f"clash{i}") for i, t in enumerate(TEXTS)] + [(3, "", "en", "s", 1, "again"), (None, "É é", None, None, None, None), (None, None, None, None, None, None), (50, "É é", "en", "s", 1, "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, name string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def key(d, t):
    return (d is None, d or 0, t or "")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize("how", [{}, {"block_bytes": 7}, {"block_bytes": 16, "key": exact_dedup.own_key}])
def test_exact_dedup(docs, how):
    got = [r.asDict() for r in exact_dedup.exact_dedup(docs, **how).collect()]
    rows = [(r["doc_id"], lower(r["text"])) for r in docs.collect()]
    assert len(got) == len(rows)
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    for r in got:
        (t,) = [t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        known = [d for d in groups[t] if d is not None]
        assert r["group_size"] == len(groups[t]) and r["keep_id"] == (max(known) if known else None) and r["doc_id"] in groups[t]
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.keep_first_copies(docs, **how).count() == len(groups)


def test_clashing_names(docs):
    """Extra columns may be called what the operators call their own."""
    from pyspark.sql import functions as F

    extra = docs.limit(5).withColumns({n: F.lit("x") for n in ("_sha", "_id", "_copies", "_fp", "_t", "fp", "name", "keys", "row_id", "f_n_words", "n_words", "_score", "h", "line", "pos")})
    assert exact_dedup.keep_first_copies(extra).columns == extra.columns and exact_dedup.exact_dedup(extra).count() == 5
    assert simhash.keep_one_of_each(extra).columns == extra.columns and simhash.near_dedup(extra).count() == 5
    assert quality_rules.keep_good(extra).columns == extra.columns and quality_rules.judge(extra).count() == 5
    assert quality_net.keep_good(extra, quality_net.Net()).columns == extra.columns
    assert tokens.encode_documents(extra, tokens.default_vocabulary()).count() == 5
    assert packing.pack(extra, tokens.default_vocabulary()).count() >= 5


def test_exact_dedup_with_meeting_hashes(docs, nothing):
    from pyspark.sql import functions as F

    def weak(block):
        return F.struct((F.octet_length(block) % 2).cast("long").alias("h"), F.lit(0).alias("g"))

    assert exact_dedup.exact_dedup(docs, key=weak, block_bytes=64).where("kept").count() == exact_dedup.exact_dedup(docs).where("kept").count()
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.keep_first_copies(nothing).count() == 0


def test_codec_joins(library):
    c = tokens.Codec(tokens.default_vocabulary(), piece_bytes=64, leaf_chars=50)
    r = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'", "é", "ñ", "1", "23", "!!", "<|endoftext|>", "<|endof", "text|>", "日本", "🙂", "x" * 70, "ab" * 60, " " * 90, "\t"]
    for _ in range(400):
        s = "".join(r.choices(parts, k=r.randint(0, 60)))
        assert c.encode(s).tolist() == ids_of(library, s)


def test_encode_documents(docs, nothing, library):
    path = tokens.default_vocabulary()
    out = tokens.digests(tokens.encode_documents(docs, path, leaf_chars=100), path).collect()
    want = []
    for r in docs.collect():
        ids = ids_of(library, r["text"])
        want.append((key(r["doc_id"], ""), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((key(r[0], ""), *r[1:]) for r in out) == sorted(want)
    assert tokens.encode_documents(nothing, path).count() == 0


@pytest.mark.parametrize("block_tokens", [300, 1 << 18])
def test_packing(docs, nothing, library, block_tokens):
    path = tokens.default_vocabulary()
    pieces = packing.digest_pieces(packing.pack(docs.coalesce(1), path, seq_len=128, block_tokens=block_tokens)).collect()
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
    padding = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        n = 0
        for p in ps:
            assert p["offset"] == n
            n += p["length"]
        assert n <= 128
        padding += 0 if n & (n - 1) == 0 else 128 - n
    total = sum(p["length"] for p in pieces)
    assert padding < 0.05 * total
    assert total == sum(len(ids_of(library, r["text"])) + 1 for r in docs.collect())
    for r in docs.collect():
        if r["doc_id"] is None or r["doc_id"] == 3:
            continue
        ids, at = [*ids_of(library, r["text"]), 0], 0
        for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    assert packing.pack(nothing, path).count() == 0


def test_cuts_lie_at_boundaries():
    """Between other tokens only where two boundaries lie further apart than a window."""
    r = np.random.default_rng(4)
    ids = r.integers(0, 50, 3000).astype(np.uint32)
    ids[1000:1400] = 7
    ends, sentence_end = np.array([200, 900, 3000]), np.arange(50) == 3
    at, penalty = packing.cut_candidates(ids, ends, sentence_end, 256)
    marks = sorted({0, 200, 900, 3000, *(np.flatnonzero(ids == 3) + 1).tolist()})
    want = set(marks) | {k for a, b in zip(marks, marks[1:]) if b - a > 256 for k in range(a, b)}
    assert at.tolist() == sorted(want) and set(penalty[np.isin(at, ends)]) == {0.0}


def test_best_cuts_is_optimal():
    r = random.Random(2)
    for _ in range(60):
        at = np.array(sorted({0, *r.sample(range(1, 60), 18), 60}))
        at = np.union1d(at, np.arange(0, 61, 15))
        pen = np.array([r.choice([0.0, 2.0, 8.0]) for _ in at])
        best = {0: 0.0}
        for j in range(1, len(at)):
            options = []
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 16:
                    options.append(best[i] + (0 if n & (n - 1) == 0 else 16 - n) + pen[j] + 1)
            best[j] = min(options)
        cuts = packing.best_cuts(at, pen, 16, 1.0)
        where = {int(x): k for k, x in enumerate(at)}
        cost = sum((0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a)) + pen[where[b]] + 1 for a, b in zip(cuts, cuts[1:]))
        assert abs(cost - best[len(at) - 1]) < 1e-9


def test_quality_rules(docs, nothing):
    def brute(t):
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    r = random.Random(3)
    for t in [*TEXTS, *(" ".join(r.choices(["a", "b", "c|", "d\n"], k=60)) for _ in range(50))]:
        assert quality_rules.figures(t or "")[:5] == brute(t)
    out = quality_rules.judge(docs)
    assert out.count() == docs.count()
    assert all(x["base_failed"] == (x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"]) and not (x["kept"] and x["base_failed"]) for x in out.collect())
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0


def brute_fingerprint(t):
    w = WORD.findall(lower(t))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, nothing):
    for t in TEXTS:
        assert simhash.fingerprint(t or "") == brute_fingerprint(t)
    out = [r.asDict() for r in simhash.near_dedup(docs).collect()]
    assert len(out) == docs.count()
    fps = [int(r["fingerprint"], 16) for r in out]
    label = list(range(len(out)))
    for _ in out:
        for i in range(len(out)):
            for j in range(len(out)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    for i, r in enumerate(out):
        ids = [out[j]["doc_id"] for j in range(len(out)) if label[j] == label[i] and out[j]["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert simhash.keep_one_of_each(docs).count() == len(set(label))
    assert simhash.near_dedup(nothing).count() == 0


def test_simhash_tiles_find_all_components(spark):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(40):
            x = b
            for k in r.integers(0, 64, r.integers(1, 5)):
                x ^= 1 << int(k)
            fps.add(x)
            b = x if r.random() < 0.3 else b
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(fps)], "_fp long, doc_id long")
    from strandlake.llm.common import Scratch

    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 4):
            x, y = find(i), find(int(j))
            label[max(x, y)] = min(x, y)
    for tile in (8, 4096):
        scratch = Scratch(spark, "test")
        edges = simhash.links(nodes.select(nodes["_fp"].alias("fp")), scratch, tile=tile)
        assert edges.count() < 64 * len(fps)
        roots = {r_["u"]: r_["root"] for r_ in simhash.components(edges, scratch).collect()}
        signed = [int(np.uint64(x).view(np.int64)) for x in fps]
        groups = {}
        for i, s in enumerate(signed):
            groups.setdefault(roots.get(s, s), set()).add(i)
        want = {}
        for i in range(len(fps)):
            want.setdefault(find(i), set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_html(spark):
    rows = [
        (1, "http://A.example/x", '<html><head><title>t</title></head><body class="nav"><nav>menu</nav><article><h1>T &amp; t</h1><p>one <b>two</b>&nbsp;\n three<p>four<br>five</p><div class="comments"><p>said</p></div></article><footer>f</footer>', "c"),
        (2, None, None, "c"), (3, "odd", "", None), (3, "odd", "", None), (4, "http://a.example/y", "plain text with a < sign", None),
        *[(10 + i, "http://b.example", f"<div>{' '.join(['this long template line repeats on each page of it'] * 1)}</div><div>page {i} says its own {'w%d ' % i * 5}</div>", None) for i in range(5)],
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {}
    for r in extract(df).collect():
        out.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    assert out[1] == [("T & t\none two three\nfour five", 29)]
    assert out[2] == [("", 0)] and out[3] == [("", 0)] * 2 and out[4][0][0] == "plain text with a < sign"
    assert out[10][0][0].startswith("0 says its own w0") and "template" not in out[10][0][0]
    assert extract(df).count() == len(rows) and extract(df.where("false")).count() == 0


def test_classifier(spark):
    r = random.Random(6)
    good = [" ".join("".join(r.choices("etaoinshr", k=r.randint(2, 8))) for _ in range(r.randint(30, 90))) + "." for _ in range(150)]
    bad = [" ".join("".join(r.choices("etaoinshr", k=r.randint(2, 8))) + r.choice(["$$$", "%%%"]) for _ in range(r.randint(30, 90))) for _ in range(150)]
    texts = [x for pair in zip(good, bad) for x in pair]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (900, "", "x"), (901, "y" * 50000, "x"), (901, "y" * 50000, "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality_net.train_on(df, labels)
    rows = quality_net.score(df, net, keep=["doc_id"]).collect()
    assert len(rows) == 304 and all(0 <= x["_score"] <= 1 for x in rows)
    held = [x for x in rows if x["doc_id"] is not None and x["doc_id"] < 300 and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert sum((x["_score"] >= 0.5) == (x["doc_id"] % 2 == 0) for x in held) > 0.95 * len(held)
    assert quality_net.keep_good(df, net).columns == df.columns
    assert quality_net.score(df.where("false"), quality_net.train_on(df.where("false"), labels)).count() == 0


def small_net():
    """With double precision, so that differences show gradients."""
    net = quality_net.Net(seed=3)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    return net


def brute_score(net, text):
    """Filters slid over each byte that they are slid over, one at a time, over every chunk."""
    raw = text.encode("utf-8", "replace")
    top = np.full(quality_net.FEATURES, 0.0)
    for at in range(0, max(1, len(raw) - quality_net.OVERLAP), quality_net.CHUNK - quality_net.OVERLAP):
        part = raw[at : at + quality_net.CHUNK]
        padded = part + bytes(quality_net.CHUNK - len(part))
        best = np.full(quality_net.FILTERS, -np.inf)
        for k in range(0, quality_net.CHUNK - quality_net.WIDTH + 1, quality_net.STEP):
            window = np.concatenate([net.embed[b] for b in padded[k : k + quality_net.WIDTH]])
            best = np.maximum(best, window @ net.filters)
        pooled = np.append(np.maximum(best + net.bias, 0), len(part) / quality_net.CHUNK)
        top = np.maximum(top, np.maximum(pooled @ net.second + net.bias2, 0))
    return 1 / (1 + np.exp(-(top @ net.last + net.bias3[0])))


def test_classifier_equals_brute_force():
    net = small_net()
    texts = ["", "a", "é" * 130, "plain words " * 50, "x" * 255, "y" * 257, "long text. " * 600]
    assert np.allclose(net.scores(texts, at_once=3), [brute_score(net, t) for t in texts], rtol=1e-5)
    for t in texts:
        raw = t.encode()
        every = net.features(*quality_net.chunks_of(raw)).max(0)
        assert np.allclose(net.features(*net.leading(raw, at_once=4)).max(0), every)


def test_classifier_gradients():
    net = small_net()
    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (10, 300, 900, 6000)]
    labels, weight = np.array([0.0, 1.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.0])
    grads = net.gradients([net.leading(t) for t in texts], labels, weight)

    def loss():
        p = np.array([brute_score(net, t.decode()) for t in texts])
        return (-(labels * np.log(p) + (1 - labels) * np.log(1 - p)) * weight).mean()

    for name in net.NAMES:
        flat, grad = getattr(net, name).reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-np.abs(grad))[:2]:
            old, step = flat[k], 1e-6
            flat[k] = old + step
            up = loss()
            flat[k] = old - step
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * step) - grad[k]) < 1e-4 * max(1, abs(grad[k])), (name, k)


def brute_posterior(rows, rounds=100, strength=0.01):
    """Expectation-maximisation document by document: rows are tuples of votes, 0 bad, 1 none, 2 good."""
    n, m = len(rows), len(rows[0])
    share = [[sum(x[j] == v for x in rows) / n for v in range(3)] for j in range(m)]
    good = [0.05 if 0 in x else 0.95 for x in rows]
    for _ in range(rounds):
        odds = {}
        for side, lean in ((1, (0.1, 1.0, 0.9)), (0, (0.9, 1.0, 0.1))):
            for j in range(m):
                prior = [(share[j][v] + 1e-3) * lean[v] for v in range(3)]
                got = [sum(q if side else 1 - q for q, x in zip(good, rows) if x[j] == v) + strength * n * prior[v] / sum(prior) for v in range(3)]
                odds[side, j] = [g / sum(got) for g in got]
        base = (sum(good) + 0.9 * strength * n) / (n + strength * n)
        new = []
        for x in rows:
            a, b = base, 1 - base
            for j, v in enumerate(x):
                a, b = a * odds[1, j][v], b * odds[0, j][v]
            new.append(a / (a + b))
        done = max(abs(p - q) for p, q in zip(new, good)) < 1e-9
        good = new
        if done:
            break
    return good


def test_posterior_equals_brute_force(spark):
    r = random.Random(9)
    rows = []
    for _ in range(400):
        good = r.random() < 0.7
        rows.append(tuple((2 if good == (r.random() < 0.85) else 0) if r.random() < 0.6 else 1 for _ in range(4)))
    coded = [sum(v * 3 ** (3 - j) for j, v in enumerate(x)) for x in rows]
    model = quality_rules.fit({k: coded.count(k) for k in set(coded)}, 4)
    assert np.allclose([model[k] for k in coded], brute_posterior(rows), atol=1e-6)
    # kept, from texts to verdict
    words = ["the", "of", "and", "to"]
    texts = [" ".join(r.choice(words) if r.random() < 0.3 else "".join(r.choices("etaoinshr", k=r.randint(3, 8))) for _ in range(r.randint(10, 90))) for _ in range(150)]
    texts = [" ".join(w + "##" for w in t.split()) if k % 5 == 0 else t.upper() if k % 7 == 0 else t for k, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    votes = []
    for t in texts:
        f = dict(zip(quality_rules.FIGURES, quality_rules.figures(t)))
        w, letters = f["n_words"], f["n_upper"] + f["n_lower"]
        votes.append((
            0 if f["n_symbols"] > 0.1 * w else 1,
            0 if f["n_marks"] > 0.2 * w else 1,
            0 if w >= 20 and f["n_upper"] > 0.4 * letters else 1,
            0 if w >= 20 and f["n_echo"] > 0.2 * w else 1,
            0 if f["n_repeat_words"] > 0.3 * w else 2 if w >= 20 and f["n_repeat_words"] == 0 else 1,
            0 if w >= 50 and f["n_stop"] < 0.02 * w else 2 if f["n_stop"] > 0.1 * w else 1,
            0 if f["word_chars"] < 2.5 * w or f["word_chars"] > 12 * w else 1,
            2 if f["n_symbols"] <= 0.02 * w and f["n_marks"] <= 0.05 * w and f["n_upper"] <= 0.2 * letters and f["n_echo"] <= 0.05 * w else 1,
        ))
    for k, q in enumerate(brute_posterior(votes)):
        assert abs(got[k]["quality"] - q) < 1e-6 and got[k]["kept"] == (not got[k]["base_failed"] and q >= 0.5)
    assert 0 < sum(x["kept"] for x in got.values()) < len(texts)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(docs, nothing, library, planes):
    files = token_files.write_token_files(docs, tokens.default_vocabulary(), 2, planes=planes, chunk_ids=777)
    back = token_files.read_token_files(files).collect()
    rows = [(r["doc_id"], [*ids_of(library, r["text"]), 2]) for r in docs.collect()]
    assert sorted((key(r["doc_id"], ""), bytes(r["ids"])) for r in back) == sorted((key(d, ""), np.array(i, "<u4").tobytes()) for d, i in rows)
    back.sort(key=lambda r: r["start"])
    at = 0
    for r in back:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    ids = [r["doc_id"] for r in back if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert token_files.read_token_files(token_files.write_token_files(nothing, tokens.default_vocabulary(), 2)).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1001, dtype=np.uint64).astype(np.uint32)
    for planes in ("byte", "bit"):
        assert (token_files.from_planes(token_files.to_planes(ids, planes), len(ids)) == ids).all()


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    r = random.Random(8)

    def prose():
        return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else "".join(r.choices("etaoinshrdl", k=r.randint(3, 9))) for _ in range(r.randint(60, 120))) + "."

    clean = [prose() for _ in range(120)]
    junk = [" ".join(w + "%%%" for w in prose().split()) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(clean + junk)] + [(500 + i, t.upper() if i % 2 else t) for i, t in enumerate(clean[:20])] + [(900, None), (901, "")]
    spark.createDataFrame([(a, b, "en", "s", 0) for a, b in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x["doc_id"] for x in pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert not kept & set(range(120, 180)) and not kept & {900, 901}
    texts = {lower(dict(docs)[d]) for d in kept}
    assert len(texts) == len(kept) and len(texts) >= 116
