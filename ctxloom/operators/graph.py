"""Traversal and ranking over edges (src, dst, kind, confidence, weight)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this many directed edges the rank runs as DataFrames; below it a numpy kernel on the driver is faster (16 bytes an edge and way).
KERNEL_EDGES = 2_000_000


def live_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes, with w = confidence x weight."""
    ids = nodes.select("id").distinct()
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inside.select("src", "dst", "kind", (F.col("confidence") * F.col("weight")).alias("w"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): edges in and out, counted as often as they are, over the largest degree (1 at least)."""
    both = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    d = nodes.select("id").join(both.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = d.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    return d.crossJoin(F.broadcast(top)).select("id", "degree", (F.col("degree") / F.col("top")).alias("centrality"))  # top is one row


def neighbors_of_kind(edges: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """(id, dst) of the outgoing edges of one kind."""
    return edges.where(F.col("kind") == kind).join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), "dst")


def neighbors(nodes: DataFrame, edges: DataFrame, start: DataFrame, kinds: tuple[str, ...] = (), direction: str = "both", depth: int = 1) -> DataFrame:
    """Breadth-first levels around ``start`` (id): (id, depth) of every node reached, the start left out, at its least depth.

    ``direction`` is out, in or both; no ``kinds`` means all; ids without a node row are passed over. The frontier alone is joined with the edges in
    each level, so a level costs what it reaches.
    """
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    steps = []
    if direction in ("out", "both"):
        steps.append(e.select(F.col("src").alias("at"), F.col("dst").alias("to")))
    if direction in ("in", "both"):
        steps.append(e.select(F.col("dst").alias("at"), F.col("src").alias("to")))
    step = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, max(depth, 1) + 1):
        reached = front.select(F.col("id").alias("at")).join(step, "at").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti")
        front = reached.withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen.where("depth > 0").join(nodes.select("id").distinct(), "id", "left_semi")


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 6) -> DataFrame:
    """One row (path array, length): a shortest path along outgoing edges, the least by its ids among equals; no row if there is none.

    Each level keeps one path to each node it reaches, so a level never has more rows than the graph has nodes.
    """
    spark = edges.sparkSession
    front = spark.createDataFrame([(start, [start])], "at string, path array<string>")
    seen = front.select("at")
    step = edges.select("src", "dst").distinct()
    if start == end:
        return front.select("path", F.lit(0).alias("length"))
    for d in range(1, most + 1):
        reached = front.join(step, F.col("at") == F.col("src")).select(F.col("dst").alias("to"), F.concat("path", F.array("dst")).alias("path"))
        fresh = reached.groupBy("to").agg(F.min("path").alias("path")).join(seen.withColumnRenamed("at", "to"), "to", "left_anti")
        front = fresh.select(F.col("to").alias("at"), "path").persist()
        hit = front.where(F.col("at") == end)
        if not hit.isEmpty():
            return hit.select("path", F.lit(d).alias("length"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("at"))
    return spark.createDataFrame([], "path array<string>, length int")


def _seed_shares(seeds: list[str]) -> dict[str, float]:
    shares: dict[str, float] = {}
    for s in seeds:
        shares[s] = shares.get(s, 0.0) + 1 / len(seeds)
    return shares


def pagerank_kernel(ids: list[str], src: np.ndarray, dst: np.ndarray, w: np.ndarray, seeds: list[str], damping: float, rounds: int) -> np.ndarray:
    """Personalised ranks over an undirected multigraph in arrays. Nodes without weight give their rank back to the seeds, undamped."""
    n = len(ids)
    restart = np.zeros(n)
    place = {x: k for k, x in enumerate(ids)}
    known = [s for s in seeds if s in place]
    if not known:
        return restart
    for s, x in _seed_shares(known).items():
        restart[place[s]] += x
    total = np.bincount(src, w, n) + np.bincount(dst, w, n)
    rank, tied = restart.copy(), total <= 0
    scale = np.where(tied, 0.0, damping / np.where(tied, 1.0, total))
    for _ in range(rounds):
        out = rank * scale
        rank, lost = np.bincount(dst, out[src] * w, n) + np.bincount(src, out[dst] * w, n) + (1 - damping) * restart, rank[tied].sum()
        rank = rank + lost * restart
    return rank


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, seeds: list[str], damping: float = 0.5, rounds: int = 25, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(id, rank) by a fixed number of rounds over the undirected graph; without a known seed every rank is 0.

    Graphs of up to ``kernel_edges`` edges are ranked by a numpy kernel on the driver; the bound is checked, and larger ones run as DataFrame rounds.
    """
    spark = nodes.sparkSession
    live = live_edges(nodes, edges)
    small = live.limit(kernel_edges + 1).count() <= kernel_edges and nodes.limit(kernel_edges + 1).count() <= kernel_edges
    return _ranks_by_kernel(spark, nodes, live, seeds, damping, rounds) if small else _ranks_by_joins(nodes, live, seeds, damping, rounds)


def _ranks_by_kernel(spark: SparkSession, nodes: DataFrame, live: DataFrame, seeds: list[str], damping: float, rounds: int) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    ids = nodes.select("id").distinct().orderBy("id").toArrow()["id"].combine_chunks()
    e = live.orderBy("src", "dst", "kind").select("src", "dst", "w").toArrow()
    at = lambda c: pc.index_in(e[c], ids).to_numpy()
    rank = pagerank_kernel(ids.to_pylist(), at("src"), at("dst"), e["w"].to_numpy(), seeds, damping, rounds)
    return spark.createDataFrame(pa.table({"id": ids, "rank": rank}))


def _ranks_by_joins(nodes: DataFrame, live: DataFrame, seeds: list[str], damping: float, rounds: int) -> DataFrame:
    """Rounds of one join and one aggregate each. A node without edges hands its rank to the seeds in the same pass, so that a round reads the one before once and plans grow by a round."""
    spark = nodes.sparkSession
    stored = spark.conf.get("spark.checkpoint.dir", None) is not None
    hold = lambda df: df.checkpoint() if stored else df.persist()
    both = live.select(F.col("src").alias("at"), F.col("dst").alias("to"), "w").unionByName(live.select(F.col("dst").alias("at"), F.col("src").alias("to"), "w"))
    pair = both.groupBy("at", "to").agg(F.sum("w").alias("w"))
    total = both.groupBy("at").agg(F.sum("w").alias("total")).where("total > 0")
    known = [r["id"] for r in nodes.where(F.col("id").isin(*seeds)).select("id").distinct().collect()] if seeds else []
    ids = nodes.select("id").distinct()
    if not known:
        return ids.withColumn("rank", F.lit(0.0))
    share = hold(pair.join(total, "at").select("at", "to", (F.lit(damping) * F.col("w") / F.col("total")).alias("share")))
    shares = _seed_shares([s for s in seeds if s in known])
    restart = spark.createDataFrame(list(shares.items()), "id string, restart double")
    base = hold(ids.join(F.broadcast(restart), "id", "left").withColumn("restart", F.coalesce("restart", F.lit(0.0))))  # as many rows as seeds
    to_seeds = F.array(*(F.struct(F.lit(s).alias("id"), F.lit(float(x)).alias("part")) for s, x in shares.items()))
    to_one = F.array(F.struct(F.col("to").alias("id"), F.col("share").alias("part")))
    ranks = base.select("id", F.col("restart").alias("rank"))
    for k in range(rounds):
        flow = ranks.withColumnRenamed("id", "at").join(share, "at", "left").select("rank", F.inline(F.when(F.col("to").isNull(), to_seeds).otherwise(to_one)))
        got = flow.groupBy("id").agg(F.sum(F.col("rank") * F.col("part")).alias("got"))
        ranks = base.join(got, "id", "left").select("id", (F.coalesce("got", F.lit(0.0)) + (1 - damping) * F.col("restart")).alias("rank"))
        if k % 4 == 3 and stored:
            ranks = ranks.checkpoint()
    return ranks
