"""Main text of web pages: page structure, and the repeats of a whole host for what structure leaves open.

Each page becomes a list of blocks of text. A block lies in an element that the page marks as its article (main), in one
that is never part of an article (boilerplate: navigation, headers, footers, asides, forms, and elements whose class or
id is a name of adverts, notices, comments and the like), or in neither (open). A class that holds such a name beside
other words (social-impact, related-work) only hints.

The token streams of all of a host's pages are searched for runs of at least MIN_TOKENS tokens that occur on two or more
different pages, and each block of each page is judged by its mark-up and by the runs together. Open blocks lose the
tokens that runs cover and keep their unique runs; a hinted block goes if runs cover all of it. Other blocks of a marked
article stay whole: a passage that two articles share is content. If a page marks an article, its open blocks are not
part of it.

A token lies in a run of MIN_TOKENS or more that another page has if and only if one of the windows of MIN_TOKENS tokens
around it is on another page. So what a suffix array of all of a host's pages covers is found by an aggregate of window
hashes (96 bits, by host), which spreads a host of any size over tasks; the result does not depend on how. Most windows
are on one page only: 32 bits of the hashes, packed, tell which may have met, a bitmap of fixed size has these, and only
windows in it are aggregated by their whole hashes. So the bitmap may let too many through and never loses one.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, freed_shuffles, python_ready, table, whole_text

MIN_TOKENS = 8
MAIN, OPEN, BOILERPLATE = 2, 1, 0
#: Added to MAIN or OPEN where a class or id hints at boilerplate.
HINT = 4

#: Bits of the map of windows that may have met: 16 MB, whatever the input. A bucket is a slice of it.
FILTER_BITS, BUCKET_BITS = 27, 8
#: Windows whose hashes a task holds at once.
HELD = 4 << 20

#: Fixed values of HTML: elements by what they do to text.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "audio", "video")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NESTING = frozenset("html head body main article section div header footer nav aside form ul ol dl table thead tbody tr td th figure figcaption details fieldset select button menu dialog blockquote center address".split())
NEVER_TEXT = frozenset("head nav aside form footer select button menu dialog".split())
ROLES = frozenset("navigation banner contentinfo search complementary dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus share sharing social "
    "related recommended newsletter subscribe signup popup modal overlay toolbar pagination".split()
)
#: Words that say where or how an element is laid out: beside a word of NAMES they leave its meaning as it is.
LAYOUT = frozenset(
    "area bar block body bottom box button buttons center col column container content desktop fixed form global group header holder icon icons inner item items js left link links "
    "list main mobile outer page panel primary right row secondary section site slot space sticky text thread title top unit widget wrap wrapper zone".split()
)

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^>]*>?)"
    r"|<[!?/][^>]*>?"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def named(value: str) -> int:
    """2 if a class or id is a name of boilerplate, 1 if it holds one beside words of other meaning, 0 if none."""
    found = 0
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w]
        if not NAMES.isdisjoint(words):
            found = max(found, 2 if all(w in NAMES or w in LAYOUT for w in words) else 1)
    return found


def kind_of(tag: str, attrs: str, around: int) -> int:
    """What an element is, by its own name and attributes and what it lies in."""
    in_main = around & 3 == MAIN
    if around == BOILERPLATE and tag != "body" or tag in NEVER_TEXT or tag == "header" and not in_main:
        return BOILERPLATE
    role, hint = "", around & HINT
    if attrs and tag not in ("html", "body"):
        for m in ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                role = value.strip().lower()
            elif by_name := named(value):
                if by_name == 2:
                    return BOILERPLATE
                hint = HINT
    if role in ROLES:
        return BOILERPLATE
    return (MAIN if tag in ("article", "main") or role == "main" or in_main else OPEN) | hint


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block with text, in page order: references decoded, white space one space."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    held: list[str] = []
    kind = OPEN

    def end_block() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((kind, text))
            held.clear()

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            held.append(html.unescape(text))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                held.append(" ")
            continue
        end_block()
        if tag not in NESTING:
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif not m["attrs"].endswith("/>"):
            stack.append((tag, kind_of(tag, m["attrs"], kind)))
        kind = stack[-1][1] if stack else OPEN
    end_block()
    return out


KEY = np.dtype([("h", "<i8"), ("g", "<i4"), ("_", "<i4")])


def tokens_of(blocks: list[tuple[int, str]]) -> list[str]:
    return [w for _, text in blocks for w in text.split(" ")]


def seed_of(where: str) -> int:
    return xxhash.xxh3_64_intdigest(where.encode("utf-8", "surrogatepass"))


def stream_hash(tokens: list[str], where: str) -> np.ndarray:
    """Tells a page's token stream: pages of a host with equal streams are one page."""
    return np.frombuffer(xxhash.xxh3_128_digest(" ".join(tokens).encode("utf-8", "surrogatepass"), seed_of(where)), KEY)[0]


class TokenHashes(dict):
    """128 bits of each token, worked out once while it is held."""

    def __missing__(self, token: str) -> bytes:
        if len(self) >= 1 << 20:
            self.clear()
        self[token] = found = xxhash.xxh3_128_digest(token.encode("utf-8", "surrogatepass"))
        return found


def window_hashes(tokens: list[str], where: str, min_tokens: int, known: TokenHashes) -> np.ndarray:
    """96 bits (h, g), by host, for each run of min_tokens tokens, by where it starts: two polynomials of its tokens' hashes, mixed."""
    n = len(tokens) - min_tokens + 1
    out = np.zeros(max(n, 0), KEY)
    if n > 0:
        own = np.frombuffer(b"".join(map(known.__getitem__, tokens)), "<u8").reshape(-1, 2)
        for name, half, factor in (("h", own[:, 0], 0x9E3779B97F4A7C15), ("g", own[:, 1], 0xD6E8FEB86659FD93)):
            x = np.full(n, seed_of(where), np.uint64)
            for k in range(min_tokens):
                x *= np.uint64(factor)
                x += half[k : k + n]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            out[name] = x.view(np.int64) if name == "h" else (x >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def streams(batches: Iterator[pa.RecordBatch], min_tokens: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """For each batch: (stream, windows) of its pages; of pages that are one, the first in a task."""
    met: set[bytes] = set()
    known = TokenHashes()
    for b in batches:
        out = []
        for where, x in zip(b.column("_host").to_pylist(), b.column("_html").to_pylist(), strict=True):
            tokens = tokens_of(blocks_of(x))
            own = stream_hash(tokens, where)
            if own.tobytes() not in met:
                met.add(own.tobytes())
                out.append((own, window_hashes(tokens, where, min_tokens, known)))
        yield out


def packed(x: np.ndarray) -> bytes:
    """Sorted numbers, as the bytes of their steps."""
    return zlib.compress(np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1), dtype=np.uint32)


def slices(held: list[np.ndarray]) -> pa.RecordBatch:
    """(bucket, what is on a page, what is on two or more) of the numbers of pages: 24 bits beside the bucket's."""
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    buckets, at = np.unique(values >> np.uint64(24), return_index=True)
    parts = [((values[i:j] & np.uint64(0xFFFFFF)).astype(np.uint32), counts[i:j] > 1) for i, j in zip(at, [*at[1:], len(values)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array([packed(v) for v, _ in parts], pa.binary()), pa.array([packed(v[c]) for v, c in parts], pa.binary())], ["bucket", "once", "twice"])


def slice_map(found: pa.Table) -> pa.Table:
    """The bucket's slice of the map: what two pages have."""
    values, counts = np.unique(np.concatenate([unpacked(x) for x in found.column("once").to_pylist()]), return_counts=True)
    bits = np.zeros(1 << (FILTER_BITS - BUCKET_BITS), bool)
    for x in (values[counts > 1], *(unpacked(x) for x in found.column("twice").to_pylist())):
        bits[x >> np.uint32(24 - FILTER_BITS + BUCKET_BITS)] = True
    return pa.table([pa.array([found.column("bucket")[0].as_py()], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["bucket", "map"])


def met_elsewhere(h: np.ndarray, g: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which rows have a window (h, g) that rows of another page (s, t) have, too."""
    order = np.lexsort((g, h))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    starts = np.flatnonzero(first)
    two = np.zeros(len(starts), bool)
    for x in (s[order], t[order]):
        two |= np.minimum.reduceat(x, starts) != np.maximum.reduceat(x, starts)
    return order[two[np.cumsum(first) - 1]]


def uncovered(blocks: list[tuple[int, str]], shared: list[int], min_tokens: int = MIN_TOKENS) -> str:
    """The text of a page; shared has the places of the windows that other pages have, too."""
    n = sum(text.count(" ") + 1 for _, text in blocks)
    edges = np.zeros(n + 1, np.int64)
    starts = np.array(shared, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + min_tokens, -1)
    cover, at, kept = np.cumsum(edges)[:-1] > 0, 0, []
    place = MAIN if any(kind & 3 == MAIN for kind, _ in blocks) else OPEN
    for kind, text in blocks:
        words = text.split(" ")
        gone = cover[at : at + len(words)]
        at += len(words)
        if kind & 3 != place or kind & HINT and gone.all():
            continue
        kept.append(text if place == MAIN else " ".join(w for w, c in zip(words, gone, strict=True) if not c))
    return "\n".join(x for x in kept if x)


def extract(pages: DataFrame, page: str = "html", url: str = "url", id_col: str = "page_id", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Per row of pages: the id and url columns, text, n_chars.

    Null html counts as empty and gives an empty text; rows with a null or odd url are one host. Repeated rows each get
    a row; rows of equal token streams are one page, so they do not make each other's text a repeat. Unclosed and
    wrongly nested tags end with what they lie in. Ids may be null or repeat; other columns don't matter.
    """
    spark = pages.sparkSession
    python_ready(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    texts = pages.select(whole_text(page).alias("_html"), host.alias("_host"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), whole_text(page).alias("_html"), host.alias("_host"))
    id_type, url_type = pages.schema[id_col].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    low, slot = np.uint64(32), np.uint64(64 - FILTER_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in streams(batches, min_tokens):
            for _, keys in found:
                held.append(np.unique(keys["h"].astype(np.uint64) >> low))
                n += len(held[-1])
                if n >= HELD:
                    yield slices(held)
                    held, n = [], 0
        if n:
            yield slices(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(window, page, place) of the windows that the map has."""
        bits = np.frombuffer(shared_map.value, np.uint8)
        for found in streams(batches, min_tokens):
            parts = []
            for own, keys in found:
                k = keys["h"].astype(np.uint64) >> slot
                at = np.flatnonzero(bits[k >> np.uint64(3)] >> (np.uint64(7) - (k & np.uint64(7))).astype(np.uint8) & 1)
                parts.append((keys["h"][at], keys["g"][at], np.full(len(at), own["h"]), np.full(len(at), own["g"]), at.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["h", "g", "s", "t", "place"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(page, place) of the windows that another page has. All rows of a window are in one task."""
        held = [[b.column(x).to_numpy(zero_copy_only=False) for x in ("h", "g", "s", "t", "place")] for b in batches]
        if held:
            h, g, s, t, place = (np.concatenate(x) for x in zip(*held, strict=True))
            found = met_elsewhere(h, g, s, t) if len(h) else np.zeros(0, np.int64)
            for k in range(0, len(found), 1 << 18):
                at = found[k : k + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(t[at]), pa.array(place[at])], ["s", "t", "place"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for b in batches:
            found = [blocks_of(x) for x in b.column("_html").to_pylist()]
            own = [stream_hash(tokens_of(x), where) for x, where in zip(found, b.column("_host").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_url"), pa.array([int(x["h"]) for x in own], pa.int64()), pa.array([int(x["g"]) for x in own], pa.int32()), pa.array([[k for k, _ in x] for x in found], pa.list_(pa.int32())), pa.array([squeeze.compress("\n".join(t for _, t in x).encode("utf-8", "surrogatepass")) for x in found], pa.binary())],
                ["_id", "_url", "s", "t", "kinds", "parts"],
            )

    def uncover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()
        for b in batches:
            out = [uncovered(list(zip(k, loosen.decompress(t).decode("utf-8", "surrogatepass").split("\n"), strict=True)) if k else [], c or [], min_tokens) for k, t, c in zip(*(b.column(x).to_pylist() for x in ("kinds", "parts", "covers")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_url"), pa.array(out, pa.string())], ["_id", "_url", "text"])

    scratch = Scratch(spark, "html_text")
    whole = np.zeros((1 << BUCKET_BITS, 1 << (FILTER_BITS - BUCKET_BITS - 3)), np.uint8)
    with freed_shuffles(spark):
        for r in texts.mapInArrow(mark, "bucket int, once binary, twice binary").groupBy("bucket").applyInArrow(slice_map, "bucket int, map binary").collect():  # the map at most
            whole[r["bucket"]] = np.frombuffer(zlib.decompress(r["map"]), np.uint8)
        shared_map = spark.sparkContext.broadcast(whole.tobytes())
        seen = texts.mapInArrow(meet, "h long, g int, s long, t int, place int").repartition("h").mapInArrow(compare, "s long, t int, place int")
        covers = scratch.save(seen.groupBy("s", "t").agg(F.collect_set("place").alias("covers")), "covers")  # at most a page's windows
    parsed = rows.mapInArrow(parse, f"_id {id_type}, _url {url_type}, s long, t int, kinds array<int>, parts binary")
    done = parsed.join(covers, ["s", "t"], "left").select("_id", "_url", "kinds", "parts", "covers").mapInArrow(uncover, f"_id {id_type}, _url {url_type}, text string")
    return done.withColumn("n_chars", F.char_length("text").cast("long")).toDF(id_col, url, "text", "n_chars")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
