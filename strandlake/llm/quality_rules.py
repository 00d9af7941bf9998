"""Quality rules under weak supervision.

Rules look at figures of a document's whole text; each votes good, votes bad or abstains. No labels are used: how often
each rule votes either way on good and on bad documents is estimated by expectation-maximisation over the counts of the
vote patterns of all documents, and a document's posterior probability of being good replaces a demand that all rules
pass. There are at most 3 ** rules patterns, whatever the number of documents, so the counts are gathered by one
aggregation and the fitted model is that small, too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, python_ready, table, whole_text

#: Fixed values of the words' and symbols' definition.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Common words of the corpus' languages.
STOP_WORDS = frozenset(
    b"the of and a to in is it that for on with as was be by are this from or an at "
    b"der die das und zu in den von mit ist im nicht ein eine auf sich des dem als "
    b"le la les de des et en un une du que qui dans pour sur est au par avec "
    b"el los las del y se por con para su al lo no es".split()
)
WINDOW = 8
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_lower", "n_stop", "n_echo", "longest_word")


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of so many words that occurs twice or more.

    Equal windows have equal sums, so windows whose sum occurs once are settled; the others are compared word by word.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    sums = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        factor = np.uint64(0xD6E8FEB86659FD93)
        for k in range(window):
            sums = sums * factor + mixed[k : k + n]
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    if not same.any():
        return 0
    at = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    rows = ids[at[:, None] + np.arange(window)]
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = at[counts[inverse.reshape(-1)] > 1]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def figures(text: str) -> tuple[int, ...]:
    """FIGURES of one text. Words are runs of characters other than space and \\t to \\r."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    known = dict.fromkeys(words)
    for i, w in enumerate(known):
        known[w] = i
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = text.count
    return (
        n,
        len(text) - sum(map(count, SPACES)),
        sum(map(count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        len(lines),
        count("!") + count("?"),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz")),
        sum(map(STOP_WORDS.__contains__, words)),
        int((ids[1:] == ids[:-1]).sum()),
        max(map(len, known), default=0),
    )


@dataclass(frozen=True)
class Rule:
    """bad and good are conditions on FIGURES; bad counts first, and neither is to abstain."""

    name: str
    bad: str | None
    good: str | None


RULES = (
    Rule("symbols", "n_symbols > 0.1 * n_words", None),
    Rule("marks", "n_marks > 0.2 * n_words", None),
    Rule("capitals", "n_words >= 20 and n_upper > 0.4 * (n_upper + n_lower)", None),
    Rule("echo", "n_words >= 20 and n_echo > 0.2 * n_words", None),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "n_words >= 20 and n_repeat_words = 0"),
    Rule("stop_words", "n_words >= 50 and n_stop < 0.02 * n_words", "n_stop > 0.1 * n_words"),
    Rule("word_length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", None),
    Rule("plain", None, "n_symbols <= 0.02 * n_words and n_marks <= 0.05 * n_words and n_upper <= 0.2 * (n_upper + n_lower) and n_echo <= 0.05 * n_words"),
)


def pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as digits of a number to the base 3: 0 bad, 1 abstains, 2 good."""
    out = F.lit(0)
    for r in rules:
        out = out * 3 + F.when(F.expr(r.bad or "false"), 0).when(F.expr(r.good or "false"), 2).otherwise(1)
    return out.cast("int")


def votes_of(p: int, n_rules: int) -> list[int]:
    return [p // 3 ** (n_rules - 1 - k) % 3 for k in range(n_rules)]


def fit(counts: dict[int, int], n_rules: int, rounds: int = 100, strength: float = 0.01) -> dict[int, float]:
    """Posterior probability of good for each vote pattern.

    Starts from: bad where any rule votes bad. strength is the weight, as a share of all documents, of a prior in which
    a rule that votes is right nine times in ten; as a share, it leaves results the same at every size.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    votes = np.array([votes_of(k, n_rules) for k in keys])
    weight = np.array([counts[k] for k in keys], float)
    hot = np.eye(3)[votes]  # pattern, rule, vote
    good = np.where((votes == 0).any(1), 0.05, 0.95)
    share = (hot * weight[:, None, None]).sum(0) / weight.sum()
    right, wrong = np.array([0.1, 1.0, 0.9]), np.array([0.9, 1.0, 0.1])  # of good and of bad documents
    pseudo = strength * weight.sum()
    for _ in range(rounds):
        cond = []
        for q, lean in ((good, right), (1 - good, wrong)):
            prior = (share + 1e-3) * lean
            prior /= prior.sum(1, keepdims=True)
            c = (hot * (weight * q)[:, None, None]).sum(0) + pseudo * prior
            cond.append(np.log(c / c.sum(1, keepdims=True)))
        base = (weight * good).sum() + 0.9 * pseudo
        base /= weight.sum() + pseudo
        gap = np.log(base / (1 - base)) + (hot * (cond[0] - cond[1])).sum((1, 2))
        new = 1 / (1 + np.exp(-np.clip(gap, -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return dict(zip(keys, good.tolist(), strict=True))


def with_figures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all of docs if None), then FIGURES; columns of docs with these names are hidden by theirs."""
    python_ready(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep)]
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], whole_text(text).alias("_t"))
    names = [f"f_{x}" for x in FIGURES]

    def run(batches):
        for b in batches:
            rows = [figures(t) for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names)))], [*b.schema.names[:-1], *names])

    schema = ", ".join([f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)] + [f"{x} long" for x in names])
    return source.mapInArrow(run, schema)


def posterior(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Callable[[Column], Column]:
    """Fits the model to a column `pattern` of all documents; returns what gives the posterior of a pattern. At most 3 ** rules rows are gathered."""
    counts = {r[0]: r[1] for r in counted.groupBy("pattern").count().collect()}
    model = fit(counts, len(rules))
    table_ = F.create_map(*[F.lit(x) for k, v in model.items() for x in (k, v)]) if model else F.create_map(F.lit(-1), F.lit(0.0))
    return lambda p: F.element_at(table_, p)


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def judge(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Per row of docs: the id column, FIGURES, base_failed, quality (posterior), kept.

    Null and empty texts have no words and fail the base. Ids may be null or repeat.
    """
    found = with_figures(docs, text, [id_col]).toDF(id_col, *FIGURES).withColumn("pattern", pattern())
    found = Scratch(docs.sparkSession, "quality_rules").save(found, "figures")
    quality = posterior(found)
    return found.withColumn("base_failed", base_failed()).withColumn("quality", quality(F.col("pattern"))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("pattern")


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, that judge keeps. Rows and votes are written once, then counted and filtered."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = with_figures(docs.toDF(*names), names[docs.columns.index(text)]).toDF(*names, *FIGURES).select(*names, pattern().alias("pattern"), base_failed().alias("failed"))
    rows = Scratch(docs.sparkSession, "quality_rules").save(rows, "votes")
    quality = posterior(rows)
    return rows.where(~F.col("failed") & (quality(F.col("pattern")) >= threshold)).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
