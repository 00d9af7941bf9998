"""Exact deduplication by deterministic block naming. DataFrame functions only.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and get integer names; then the
distinct pairs of adjacent names are sorted and named, level by level, until one name is left for each document. Two
documents have the same (levels, name) exactly if their texts are equal: a name stands for one block, or one pair of
names, and never for two.

Blocks travel to their names by a 96-bit key of hashes instead of their bytes. The names are made from the blocks
themselves, and a key that belongs to two different blocks is found by counting; then the blocks themselves become the
key. So no outcome depends on hashes being free of collisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import Scratch, bounded_batches, lower_az, table, whole_text

BLOCK_BYTES = 4096


def hash_key(block: Column) -> Column:
    return F.struct(F.xxhash64(block).alias("h"), F.hash(block).alias("g"))


def own_key(block: Column) -> Column:
    """The block is its own key: for when hashes of different blocks meet."""
    return F.struct(block.alias("h"), F.lit(0).alias("g"))


def _named(keys: DataFrame, by: list[str]) -> DataFrame:
    """Integer names of distinct rows. They are sorted, so that a partition computed again gives the same names."""
    return keys.distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, text: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES, key: Callable[[Column], Column] = hash_key) -> DataFrame:
    """One row per row of docs: row_id, the id column, text_sha256, levels, name; the last two are the text's identity.

    A null text counts as empty; an empty text is one empty block. Repeated rows each get a row. Columns of docs other
    than the two named are not read.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "block_names")
    norm = lower_az(whole_text(text)).cast("binary")
    source = docs.select(F.col(id_col), norm.alias("_b")).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.octet_length("_b") / F.lit(block_bytes))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(F.col("_b"), i * block_bytes + 1, F.lit(block_bytes)))

    def level_zero(key: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
        rows = scratch.save(source.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col), F.sha2(F.col("_b"), 256).alias("text_sha256"), F.transform(blocks, key).alias("keys")), f"rows_{key.__name__}")
        cut = source.select(F.explode(blocks).alias("block"))
        names = scratch.save(_named(cut.select(key(F.col("block")).alias("key"), "block").select("key.*", "block"), ["h", "g", "block"]).drop("block"), f"names_{key.__name__}")
        return rows, names

    rows, names = level_zero(key)
    if names.groupBy("h", "g").count().where("count > 1").limit(1).count():
        rows, names = level_zero(own_key)
    done = []
    now = rows.select("row_id", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).select("row_id", "n", "pos", "key.*").join(names, ["h", "g"]).select("row_id", "n", "pos", "name")
    level, most = 0, rows.agg(F.max(F.size("keys"))).first()[0] or 0
    while most > 0:
        now = scratch.save(now, f"level_{level}")
        done.append(now.where("n = 1").select("row_id", F.lit(level).alias("levels"), "name"))
        if most == 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = now.where("n > 1").groupBy("row_id", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(F.ceil(F.max("n") / 2).cast("int").alias("n"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        now = pairs.join(scratch.save(_named(pairs.select("a", "b"), ["a", "b"]), f"pairs_{level}"), ["a", "b"]).select("row_id", "n", "pos", "name")
        level, most = level + 1, -(-most // 2)
    if not done:
        return rows.select("row_id", id_col, "text_sha256", F.lit(0).alias("levels"), F.lit(0).cast("long").alias("name"))
    names = done[0]
    for x in done[1:]:
        names = names.union(x)
    return rows.drop("keys").join(names, "row_id").select("row_id", id_col, "text_sha256", "levels", "name")


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """Per row of docs: the id column, keep_id, group_size, kept, text_sha256, copies.

    Of equal texts the row with the largest id stays; null ids come before all others. Of repeated rows (same id, same
    text) one stays, so that exactly one row of every group is kept. copies counts the rows of a group that share the id.
    """
    scratch = Scratch(docs.sparkSession, "exact_dedup")
    named = scratch.save(block_names(docs, text, id_col, **how), "named")
    last = F.max(F.struct(F.col(id_col), F.col("row_id")))
    groups = named.groupBy("levels", "name").agg(last.alias("_top"), F.count(F.lit(1)).alias("group_size"))
    groups = scratch.save(groups, "groups")  # so that both sides of the join below are exchanges, whose hot partitions are split
    kept = F.col("row_id") == F.col("_top.row_id")
    return named.join(groups, ["levels", "name"]).select(F.col(id_col), F.col(f"_top.{id_col}").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def keep_first_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all their columns, that exact_dedup keeps. A kept row is found again by its id and text; of rows that repeat both, one stays."""
    named = Scratch(docs.sparkSession, "exact_dedup").save(block_names(docs, text, id_col, **how), "named")
    top = named.groupBy("levels", "name").agg(F.max(F.struct(F.col(id_col), F.col("row_id"))).alias("_top"))
    tops = named.join(top, ["levels", "name"]).where(F.col(id_col).eqNullSafe(F.col(f"_top.{id_col}")))
    keys = tops.groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("_copies"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes with those joined to it
    own_text, own_id = names[docs.columns.index(text)], names[docs.columns.index(id_col)]
    own = docs.toDF(*names).withColumn("_sha2", F.sha2(lower_az(whole_text(own_text)).cast("binary"), 256))
    found = own.join(keys, F.col("_sha2").eqNullSafe(F.col("_sha")) & F.col(own_id).eqNullSafe(F.col("_id")))
    once, more = found.where("_copies = 1"), found.where("_copies > 1").dropDuplicates([own_id, "_sha"])
    return once.union(more).select(*names).toDF(*docs.columns)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
