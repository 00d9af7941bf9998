import html as references
import random

import pytest

from strandlake.llm.html_text import blocks_of, extract, named

PAGE = "page_id long, url string, html string"


def brute(pages, n=8):
    """Open pages: (host, list of open paragraphs). A token goes if a run of n tokens around it is on a different page of the host, found by looking through the pages."""
    out = []
    for host, paragraphs in pages:
        stream = [w for p in paragraphs for w in p.split()]
        others = [[w for p in q for w in p.split()] for h, q in pages if h == host]
        gone = [False] * len(stream)
        for k in range(len(stream) - n + 1):
            run = stream[k : k + n]
            if any(o != stream and any(o[i : i + n] == run for i in range(len(o) - n + 1)) for o in others):
                gone[k : k + n] = [True] * n
        at, kept = 0, []
        for p in paragraphs:
            words = p.split()
            kept.append(" ".join(w for w, g in zip(words, gone[at : at + len(words)]) if not g))
            at += len(words)
        out.append("\n".join(k for k in kept if k))
    return out


def test_open_pages_equal_brute_force(spark):
    r = random.Random(3)
    runs = [[f"r{k}y{i}" for i in range(r.randint(4, 20))] for k in range(12)]
    pages = []
    for k in range(60):
        paragraphs = []
        for _ in range(r.randint(1, 4)):
            words = [f"w{r.randint(0, 40)}" for _ in range(r.randint(1, 12))]
            for _ in range(r.randint(0, 2)):
                at = r.randint(0, len(words))
                words[at:at] = r.choice(runs)[: r.randint(3, 20)]
            paragraphs.append(" ".join(words))
        pages.append((f"h{r.randint(0, 3)}.example", paragraphs))
    pages += [pages[0], pages[1]]  # equal pages are one
    rows = [(k, f"http://{h}/{k}", "<body>" + "".join(f"<p>{references.escape(p)}</p>" for p in ps) + "</body>") for k, (h, ps) in enumerate(pages)]
    want = brute(pages)
    for parts in (1, 7):
        got = {x["page_id"]: x for x in extract(spark.createDataFrame(rows, PAGE).repartition(parts)).collect()}
        assert [got[k]["text"] for k in range(len(rows))] == want
        assert all(x["n_chars"] == len(x["text"]) for x in got.values())


def test_names_hint_or_decide():
    assert [named(x) for x in ("comments", "ad-box", "siteFooter", "top menu", "cookie-notice")] == [2] * 5
    assert [named(x) for x in ("social-impact", "related-work", "share-prices", "comment-on-x")] == [1] * 4
    assert [named(x) for x in ("story", "adapt", "paragraph lead", "")] == [0] * 4


def test_hinted_text_goes_only_if_it_repeats(spark):
    same = "follow us on all of the networks that we are on today"
    rows = [(k, "http://h.example/", f'<article><p>text {k}</p><div class="social-impact">body {k} of its own</div><div class="share-us">{same}</div><p>{same}</p></article>') for k in range(3)]
    got = {x["page_id"]: x["text"] for x in extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {k: f"text {k}\nbody {k} of its own\n{same}" for k in range(3)}


@pytest.mark.parametrize("inner", ["<div>" * 3000 + "deep" + "</div>" * 3000, "<b><i>open <p>never closed", "<p>long " + "word " * 60000, "<a href='x>odd</a> quotes"])
def test_odd_pages(spark, inner):
    row = (1, "http://h.example/", f"<nav>menu<ul></nav><article>{inner}</article><footer>f</footer>")
    (got,) = extract(spark.createDataFrame([row, row], PAGE)).distinct().collect()
    assert "menu" not in got["text"] and got["n_chars"] == len(got["text"])
    if "odd" not in inner:
        assert got["text"].split()[-1] in ("deep", "closed", "word")
    assert all(" ".join(t.split()) == t for _, t in blocks_of(row[2]))
