"""Running sums, maxima and neighbours over long partitions, computed bin by bin.

A window over a whole chromosome is one task. Here rows are first summed up by bin, the few sums of the bins before are
carried in, and the row-wise window stays within a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 16


def running(df: DataFrame, by: list[str], position: str, order: list[str | Column], value: Column, how: str, name: str, before_only: bool = False, bin_width: float = BIN) -> DataFrame:
    """Adds `name`: the sum, max or min of value over the rows up to this one (or before it) of its partition in that order.

    order must begin with position, ascending, and be total up to rows that are alike.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}[how]
    rows = df.withColumn("_bin", F.floor(F.col(position) / bin_width)).withColumn("_v", value)
    bins = rows.groupBy(*by, "_bin").agg(agg("_v").alias("_all"))
    carried = bins.select(*by, "_bin", agg("_all").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    here = Window.partitionBy(*by, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before_only else 0)
    rows = rows.withColumn("_own", agg("_v").over(here))
    return _with_carried(rows, carried, by).withColumn(name, join(F.col("_own"), F.col("_carry"))).drop("_bin", "_v", "_own", "_carry")


def neighbour(df: DataFrame, by: list[str], position: str, order: list[str], value: Column, name: str, ahead: bool, bin_width: float = BIN) -> DataFrame:
    """Adds `name`: value in the next row of the partition in that order (ahead), or in the one before; null where there is none.

    order must begin with position, ascending, and be total up to rows that are alike. Only the outermost row of each bin
    meets those of other bins.
    """
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    rows = df.withColumn("_bin", F.floor(F.col(position) / bin_width)).withColumn("_v", F.struct(value.alias("v")))
    edges = rows.groupBy(*by, "_bin").agg(edge("_v", F.struct(*order)).alias("_edge"))
    carried = edges.select(*by, "_bin", step("_edge").over(Window.partitionBy(*by).orderBy("_bin")).alias("_carry"))
    rows = rows.withColumn("_own", step("_v").over(Window.partitionBy(*by, "_bin").orderBy(*order)))
    return _with_carried(rows, carried, by).withColumn(name, F.coalesce("_own", "_carry")["v"]).drop("_bin", "_v", "_own", "_carry")


def _with_carried(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the column _carry of their bin."""
    carried = carried.withColumnRenamed("_bin", "_bin2")
    for c in by:
        carried = carried.withColumnRenamed(c, f"_{c}2")
    same = F.col("_bin").eqNullSafe(F.col("_bin2"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}2"))
    return rows.join(carried, same).drop("_bin2", *[f"_{c}2" for c in by])
