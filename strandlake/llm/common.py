"""What the operators of this subpackage share: written intermediate tables (of strandlake.scratch), worker set-up and key expressions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.scratch import Scratch, clear_scratch, freed_shuffles, shared_dir

__all__ = ["Scratch", "bounded_batches", "clear_scratch", "freed_shuffles", "lower_az", "python_ready", "shared_dir", "table", "whole_text"]

ROOT = str(Path(__file__).resolve().parents[2])


#: The most rows of a batch that goes to Python and of one that is read from Parquet, and the most bytes of the first.
#: A batch of the reader has no bound in bytes and holds its texts in one array: at Spark's 4096 rows, texts of 340 kB fill 1.4 GB.
BATCH_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20, "spark.sql.parquet.columnarReaderBatchSize": 64}


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what is held at once, as texts can be long. The session keeps the bounds, which only ever become smaller: plans are run after the operator has returned."""
    for name, bound in BATCH_BOUNDS.items():
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(name, str(bound))


def python_ready(spark: SparkSession) -> None:
    """Lets Python workers import this package, and bounds batches."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    bounded_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_az(col: Column) -> Column:
    """Lower-cases A-Z only. On ASCII texts lower() does just that, and faster than translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))
