"""Snapshots of nodes and edges: upserts where the last row wins, pruning, and a schema gate.

Plain Parquet has no MERGE, so a write makes a new snapshot directory and then names it in a small pointer file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
NODE_KINDS = ("repo", "file", "symbol", "route", "api_call", "table", "external_dep", "commit", "author")
EDGE_KINDS = ("contains", "defined_in", "calls", "imports", "depends_on", "calls_api", "extends_implements", "injects", "tests", "handles", "persists_to", "modified_by", "authored_by", "co_changed_with")
NODES = "id string, key string, kind string, name string, repo string, path string, start_line int, end_line int, signature string, doc string, lang string, content_hash string, mtime bigint, attrs string"
EDGES = "src string, dst string, kind string, provenance string, confidence double, weight double"


def last_rows(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``; the limit applies before the shuffle, so repeated keys send one row a task."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def upsert_nodes(now: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """``now`` with the rows of ``batch`` (the same columns and ``seq``, their order): the last row of an id replaces it, but its first key stays."""
    fresh = last_rows(batch, ["id"], F.col(seq))
    first = last_rows(batch, ["id"], -F.col(seq)).select("id", F.col("key").alias("__first"))
    old = now.select("id", F.col("key").alias("__old"))
    fresh = fresh.join(first, "id").join(old, "id", "left").withColumn("key", F.coalesce("__old", "__first")).select(*now.columns)
    return now.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def upsert_edges(now: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """``now`` with ``batch``: the last row of (src, dst, kind) wins."""
    keys = ["src", "dst", "kind"]
    fresh = last_rows(batch, keys, F.col(seq)).select(*now.columns)
    return now.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def prune_missing(nodes: DataFrame, edges: DataFrame, repo: str, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``repo`` whose path is not among ``seen`` (path; case does not count), and without edges that lost an end."""
    gone = nodes.where((F.col("repo") == repo) & F.col("path").isNotNull()).join(seen.select(F.lower("path").alias("__k")).distinct(), F.lower("path") == F.col("__k"), "left_anti").select("id")
    return without(nodes, edges, gone)


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = gone.select("id").distinct()
    kept = nodes.join(gone, "id", "left_anti")
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return kept, left.select(*edges.columns)


def prune_orphans(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("external_dep", "commit", "author"), passes: int = 5) -> tuple[DataFrame, DataFrame]:
    """Without nodes of ``kinds`` that no edge leads to, again and again until none is left or ``passes`` are over."""
    for _ in range(passes):
        gone = nodes.where(F.col("kind").isin(*kinds)).join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id")
        if gone.isEmpty():
            break
        nodes, edges = without(nodes, edges, gone)
    return nodes, edges


def lookup(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows whose values are in ``keys``, whose columns name those compared; keys without a row give none."""
    return rows.join(keys.distinct(), keys.columns, "left_semi").select(*columns)


class Store:
    """Snapshots below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def state(self) -> dict:
        fs, path = self._path("current.json")
        if not fs.exists(path):
            return {"schema_version": SCHEMA_VERSION, "snapshot": None, "metrics": None, "meta": {}}
        state = json.loads(self.spark.read.option("wholetext", True).text(path.toString()).first()[0])
        if state["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"the store has schema {state['schema_version']}, this engine {SCHEMA_VERSION}: rebuild the index")
        return state

    def write(self, nodes: DataFrame, edges: DataFrame, metrics: dict | None = None, cache: DataFrame | None = None) -> None:
        """A new snapshot, nodes by kind, and the extraction cache that goes with it; the pointer changes once it stands."""
        state = self.state()
        name = f"snapshot-{(int((state['snapshot'] or 'snapshot-0').split('-')[1]) + 1):06d}"
        nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/{name}/nodes")
        edges.write.mode("overwrite").parquet(f"{self.root}/{name}/edges")
        if cache is not None:
            cache.write.mode("overwrite").parquet(f"{self.root}/{name}/cache")
        self._point(state | {"snapshot": name, "metrics": metrics})

    def _point(self, state: dict) -> None:
        fs, path = self._path("current.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def get_meta(self, key: str) -> str | None:
        return self.state().get("meta", {}).get(key)

    def set_meta(self, key: str, value: str) -> None:
        """Keeps a value by its key, over a former one; new snapshots leave it as it is."""
        state = self.state()
        self._point(state | {"meta": state.get("meta", {}) | {key: value}})

    def node(self, id: str) -> dict | None:
        """The node with this id, if there is one."""
        found = self.nodes().where(F.col("id") == id).first()
        return found and found.asDict()

    def file_hash(self, repo: str, path: str) -> str | None:
        found = self.nodes().where((F.col("kind") == "file") & (F.col("repo") == repo) & (F.col("path") == path)).first()
        return found and found["content_hash"]

    def nodes(self) -> DataFrame:
        name = self.state()["snapshot"]
        columns = [c.split()[0] for c in NODES.split(", ")]
        return self.spark.read.schema(NODES).parquet(f"{self.root}/{name}/nodes").select(*columns) if name else self.spark.createDataFrame([], NODES)

    def edges(self) -> DataFrame:
        name = self.state()["snapshot"]
        return self.spark.read.schema(EDGES).parquet(f"{self.root}/{name}/edges") if name else self.spark.createDataFrame([], EDGES)

    def cache(self, schema: str) -> DataFrame:
        """The extraction cache of the current snapshot; empty where there is none."""
        name = self.state()["snapshot"]
        fs, path = self._path(f"{name}/cache")
        return self.spark.read.schema(schema).parquet(path.toString()) if name and fs.exists(path) else self.spark.createDataFrame([], schema)

    def clear(self) -> None:
        fs, path = self._path("")
        fs.delete(path, True)
