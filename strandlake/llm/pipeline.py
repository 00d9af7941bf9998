"""Stages of the corpus pipeline, each one operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import exact_dedup, packing, quality_net, quality_rules, simhash
from strandlake.llm.common import Scratch, table
from strandlake.llm.tokens import default_vocabulary


def judge_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base or is more likely bad than good; null and empty texts fail the base."""
    return quality_rules.keep_good(docs)


def judge_by_net(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows of the whole table: those that the stages before have removed are the bad examples."""
    net = quality_net.train_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_net.keep_good(docs, net)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, keeps the one with the largest id."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by like fingerprints, keeps the one with the smallest id."""
    return simhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows' tokens, null text as empty."""
    return packing.digest_pieces(packing.pack(docs, default_vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", judge_by_rules),
    ("quality_classifier", judge_by_net),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack),
]

#: No SQL expresses all stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = scratch.save(done, name) if i < len(STAGES) - 1 else done
    return docs
