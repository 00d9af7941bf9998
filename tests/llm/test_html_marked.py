from strandlake.llm.html_text import extract
from strandlake.scratch import Scratch


def test_pages_that_mark_an_article_are_searched(spark):
    """Runs of all pages are looked for, those of marked articles, too; mark-up and runs then judge each block together."""
    same = [f"s{i}" for i in range(11)]
    pages = [[f"a{k}w{i}" for i in range(9 + k)] + same[: 8 + k] for k in range(4)] + [same]
    hosts = ["h.example"] * 4 + ["other.example"]
    rows = [(k, f"http://{h}/", f"<nav>menu</nav><article><p>{' '.join(p)}</p></article>") for k, (h, p) in enumerate(zip(hosts, pages, strict=True))]
    rows.append((9, *rows[0][1:]))  # an equal page makes nothing a repeat
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {**{k: " ".join(p) for k, p in enumerate(pages)}, 9: " ".join(pages[0])}
    root = [r for r in Scratch.roots if "/html_text-" in r][-1]
    streams = [["menu", *p] for p in pages]

    def places(k):
        runs = [[tuple(x[i : i + 8]) for i in range(len(x) - 7)] for x in streams]
        others = {r for j, x in enumerate(runs) if j != k and hosts[j] == hosts[k] for r in x}
        return [i for i, r in enumerate(runs[k]) if r in others]

    found = sorted(sorted(r["covers"]) for r in spark.read.parquet(f"{root}/covers").collect())
    assert found == sorted(places(k) for k in range(4)) and not places(4) and all(found)
