"""Connected components of a graph as DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each source has one edge, and no end is a source."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst: long); the component is its smallest node.

    No node, link or component reaches the driver: each round is two aggregates and joins, written to
    ``scratch``, and one more aggregate tells whether only stars are left. Loops and
    null ends are ignored, repeated links count once, an empty table gives an empty table. A hub's rows meet
    in a sort-merge join, which Spark splits where one key is large.
    """
    edges = edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now, last, k = scratch.keep(edges, "cc0", small=True), "cc0", 0
    while not _settled(now):
        k += 1
        if k > most_rounds:
            raise RuntimeError("components did not settle")
        now = scratch.keep(_small_star(_large_star(now)), f"cc{k}", small=True)
        scratch.drop(last)
        last = f"cc{k}"
    roots = now.select(F.col("dst").alias("node")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
