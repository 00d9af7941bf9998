"""A cached graph of table steps, and its lineage.

A node is a function of its parents' tables. Its key is a hash of its code, its parameters and its parents' keys; a
result is written once under its key and read again by any later run with the same key. Nodes of one level don't depend
on each other and are submitted together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.scratch import Scratch


@dataclass
class Node:
    name: str
    step: Callable[..., DataFrame]
    parents: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    cache: bool = True


class Graph:
    def __init__(self, root: str):
        self.root, self.nodes = root.rstrip("/"), {}

    def add(self, name: str, step: Callable[..., DataFrame], parents: tuple[str, ...] = (), cache: bool = True, **parameters) -> Graph:
        if name in self.nodes:
            raise ValueError(f"{name} is there already")
        lost = [p for p in parents if p not in self.nodes]
        if lost:
            raise ValueError(f"unknown parents: {', '.join(lost)}")
        self.nodes[name] = Node(name, step, tuple(parents), parameters, cache)
        return self

    def levels(self) -> list[list[str]]:
        """Names by distance from the sources. Parents are added before children, so there are no cycles."""
        depth: dict[str, int] = {}
        for n in self.nodes.values():
            depth[n.name] = 1 + max((depth[p] for p in n.parents), default=-1)
        return [sorted(k for k, d in depth.items() if d == i) for i in range(max(depth.values(), default=-1) + 1)]

    def key(self, name: str) -> str:
        n = self.nodes[name]
        code = n.step.__code__
        text = json.dumps([code.co_code.hex(), repr(code.co_consts), code.co_names, n.parameters, [self.key(p) for p in n.parents]], sort_keys=True, default=repr)
        return hashlib.sha256(text.encode()).hexdigest()[:24]

    def _exists(self, spark: SparkSession, path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def run(self, spark: SparkSession, at_once: int = 4) -> tuple[dict[str, DataFrame], dict[str, bool]]:
        """The tables by name, and which of them were read from the cache."""
        tables: dict[str, DataFrame] = {}
        hit: dict[str, bool] = {}

        def one(name: str) -> tuple[str, DataFrame, bool]:
            n, path = self.nodes[name], f"{self.root}/{self.key(name)}"
            if n.cache and self._exists(spark, path):
                return name, spark.read.parquet(path), True
            df = n.step(spark, *[tables[p] for p in n.parents], **n.parameters)
            if n.cache:
                df.write.mode("overwrite").parquet(path)
                df = spark.read.parquet(path)
            return name, df, False

        with ThreadPoolExecutor(at_once) as pool:
            for level in self.levels():
                for name, df, was in pool.map(one, level):
                    tables[name], hit[name] = df, was
        return tables, hit

    def lineage(self, spark: SparkSession) -> DataFrame:
        """Rows node, parent, key, parameters; a source has one row without parent."""
        rows = [(n.name, p, self.key(n.name), json.dumps(n.parameters, sort_keys=True, default=repr)) for n in self.nodes.values() for p in n.parents or (None,)]
        return spark.createDataFrame(rows, "node string, parent string, key string, parameters string")


def closure(spark: SparkSession, edges: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """All ancestors of each node and their least distance; edges must have no cycles.

    up holds the walks of 1 to n steps by their ends and length, jump those of just n; one join of both gives the walks of n + 1
    to 2 n steps. So rounds grow with the logarithm of the depth, and a walk's ends come out once for each length. Each
    round is written, as many rows as it may have.
    """
    scratch = Scratch(spark, "closure")
    up = scratch.save(edges.where(F.col(parent).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct(), "up_1")
    jump, n, most = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further")), 1, up.count()
    while True:
        longer = scratch.save(up.join(jump, "ancestor").select("node", F.col("further").alias("ancestor"), (F.col("depth") + n).alias("depth")).distinct(), f"up_{2 * n}")
        if not longer.limit(1).count():
            return up.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        if n > most:
            raise ValueError("edges have a cycle")
        twice = jump.join(jump.toDF("further", "last"), "further").select("ancestor", F.col("last").alias("further")).distinct()
        up, jump, n = up.unionByName(longer), scratch.save(twice, f"jump_{2 * n}"), 2 * n
