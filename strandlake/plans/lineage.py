"""Provenance of tables: a record of operations, its queries, and hashes of contents."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans.dag import closure


class Lineage:
    """Operations, each with an id, parameters, parents and a time. Safe to use from several threads."""

    def __init__(self, most: int | None = None):
        self.nodes: dict[str, dict] = {}
        self.most, self._lock = most, threading.Lock()

    def record(self, operation: str, parents: list[str] = (), key: str | None = None, **parameters) -> str:
        with self._lock:
            lost = [p for p in parents if p not in self.nodes]
            if lost:
                raise ValueError(f"unknown parents: {', '.join(lost)}")
            key = key or uuid.uuid4().hex
            if key in self.nodes:
                raise ValueError(f"{key} is recorded already")
            if self.most is not None and len(self.nodes) >= self.most:
                raise ValueError("the record is full")
            self.nodes[key] = {"operation": operation, "parents": list(parents), "parameters": parameters, "time": time.time()}
            return key

    def find(self, pattern: str) -> list[str]:
        return [k for k, n in self.nodes.items() if re.search(pattern, n["operation"])]

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each edge; a node without parents has one without parent."""
        rows = [(k, n["operation"], p, json.dumps(n["parameters"], sort_keys=True, default=repr), n["time"]) for k, n in self.nodes.items() for p in n["parents"] or (None,)]
        return spark.createDataFrame(rows, "node string, operation string, parent string, parameters string, time double")

    def ancestors(self, spark: SparkSession, key: str) -> DataFrame:
        return closure(spark, self.table(spark)).where(F.col("node") == key).select("ancestor", "depth")

    def descendants(self, spark: SparkSession, key: str) -> DataFrame:
        return closure(spark, self.table(spark)).where(F.col("ancestor") == key).select(F.col("node").alias("descendant"), "depth")

    def merged(self, other: Lineage) -> Lineage:
        """Both records; a node that both hold must be the same in both."""
        out = Lineage()
        out.nodes = dict(self.nodes)
        for k, n in other.nodes.items():
            if k in out.nodes and out.nodes[k] != n:
                raise ValueError(f"{k} differs between the records")
            out.nodes[k] = n
        return out

    def difference(self, other: Lineage) -> tuple[list[str], list[str], list[str]]:
        """Nodes only here, only there, and in both but different."""
        a, b = self.nodes, other.nodes
        return sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys()), sorted(k for k in a.keys() & b.keys() if {**a[k], "time": 0} != {**b[k], "time": 0})

    def to_json(self) -> str:
        """Activities and what informed them, in the shape of the W3C provenance vocabulary."""
        act = {k: {"prov:label": n["operation"], "prov:startTime": n["time"], "parameters": n["parameters"]} for k, n in self.nodes.items()}
        informed = {f"{k}#{i:06d}": {"prov:informed": k, "prov:informant": p} for k, n in self.nodes.items() for i, p in enumerate(n["parents"])}
        return json.dumps({"activity": act, "wasInformedBy": informed}, sort_keys=True, default=repr)

    @classmethod
    def from_json(cls, text: str) -> Lineage:
        doc, out = json.loads(text), cls()
        for k, a in doc["activity"].items():
            out.nodes[k] = {"operation": a["prov:label"], "parents": [], "parameters": a["parameters"], "time": a["prov:startTime"]}
        for e in doc["wasInformedBy"].values():
            out.nodes[e["prov:informed"]]["parents"].append(e["prov:informant"])
        return out

    def to_mermaid(self) -> str:
        name = {k: f"n{i}" for i, k in enumerate(self.nodes)}
        lines = ["graph TD", *(f'  {name[k]}["{n["operation"]}"]' for k, n in self.nodes.items()), *(f"  {name[p]} --> {name[k]}" for k, n in self.nodes.items() for p in n["parents"])]
        return "\n".join(lines)

    @contextmanager
    def step(self, operation: str, parents: list[str] = (), **parameters):
        """Records an operation that succeeds; one that fails leaves no node."""
        yield
        self.record(operation, parents, **parameters)


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def content_hash(df: DataFrame) -> str:
    """Equal for equal collections of rows under equal schemas, whatever their order: one aggregation.

    Two sums of independent 64-bit row hashes and the count; maps are hashed as sorted entries.
    """
    cols = [F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]
    nulls = [F.col(f"`{c}`").isNull() for c in df.columns]
    wide = "decimal(38,0)"
    a, b = F.xxhash64(*cols, *nulls), F.xxhash64(F.lit(7), *nulls, *cols)
    r = df.agg(F.count(F.lit(1)), F.sum(a.cast(wide)), F.sum(b.cast(wide))).first()
    return hashlib.sha256(f"{schema_hash(df)}|{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
