import itertools

import numpy as np
import pytest

from strandlake.operators import models as md

MODEL = md.Hmm(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.4, 0.1, 0.1, 0.4], [0.1, 0.4, 0.4, 0.1]]))


def brute(m, text):
    x = m.codes(text)
    paths = {}
    for p in itertools.product((0, 1), repeat=len(x)):
        v = m.start[p[0]] * m.emit[p[0], x[0]]
        for t in range(1, len(x)):
            v *= m.move[p[t - 1], p[t]] * m.emit[p[t], x[t]]
        paths[p] = v
    return paths


def test_forward_backward():
    for text in ("A", "ACGGT", "CCATTGA"):
        paths = brute(MODEL, text)
        total = sum(paths.values())
        g, moves, ll = MODEL.forward_backward(text)
        assert ll == pytest.approx(np.log(total))
        for t in range(len(text)):
            assert g[t, 1] == pytest.approx(sum(v for p, v in paths.items() if p[t] == 1) / total)
        want = np.zeros((2, 2))
        for p, v in paths.items():
            for a, b in zip(p, p[1:]):
                want[a, b] += v / total
        assert moves == pytest.approx(want)
        assert paths[tuple(map(int, MODEL.decode(text)))] == pytest.approx(max(paths.values()))
    assert np.isfinite(MODEL.forward_backward("ACGT" * 5000)[2])


def test_training_raises_the_likelihood(spark):
    r = np.random.default_rng(3)
    texts = []
    for _ in range(30):
        s, out = r.integers(2), []
        for _ in range(80):
            out.append("ACGT"[r.choice(4, p=MODEL.emit[s])])
            s = r.choice(2, p=MODEL.move[s])
        texts.append("".join(out))
    df = spark.createDataFrame([(t,) for t in [*texts, ""]], "seq string")
    first = md.Hmm(np.array([0.5, 0.5]), np.array([[0.6, 0.4], [0.4, 0.6]]), np.array([[0.3, 0.2, 0.2, 0.3], [0.2, 0.3, 0.3, 0.2]]))
    model, ll = md.baum_welch(df, "seq", first, rounds=8)
    assert all(b >= a - 1e-6 for a, b in zip(ll, ll[1:])) and ll[-1] > ll[0]
    assert model.emit.sum(1) == pytest.approx([1, 1])
