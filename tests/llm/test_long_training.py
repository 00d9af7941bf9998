import random

import numpy as np

from strandlake.llm import quality_net


def test_training_searches_long_texts_a_bounded_number_of_times(monkeypatch):
    """All chunks of a text are searched each time it is searched, but not each time it is drawn; what is found still tells the classes apart."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts, labels = [], np.array([k % 2 for k in range(24)], np.float32)
    for k in range(24):
        words = [word() for _ in range(2000)]
        for at in r.sample(range(2000), 12):
            words[at] = "QZQZQZQZ" if k % 2 else "XWXWXWXW"
        texts.append(" ".join(words).encode())
    texts[3], texts[4] = b"QZQZQZQZ", b"XWXWXWXW"
    searched, leading = [], quality_net.Net.leading
    monkeypatch.setattr(quality_net.Net, "leading", lambda self, raw: searched.append(len(raw)) or leading(self, raw))
    room = 1 << 20
    net = quality_net.Net().train(texts, labels, steps=90, batch=8, search_bytes=room)
    assert sum(n for n in searched if n > 100) <= room + sum(map(len, texts))
    assert {len(t) for t in texts} == set(searched) and searched.count(8) == 2 * 90 * 8 // 24
    assert ((net.scores([t.decode() for t in texts]) >= 0.5) == labels).all()


def test_chunks_of_a_part_of_a_text():
    raw = bytes(random.Random(1).randrange(1, 256) for _ in range(5000))
    at = quality_net.chunk_starts(len(raw))
    whole, fill = quality_net.chunks_of(raw)
    for k in range(len(at)):
        part, share = quality_net.chunks_of(raw, at[k : k + 3])
        assert (part == whole[k : k + 3]).all() and (share == fill[k : k + 3]).all()
