"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

A shard's graph is built in passes: greedy searches from a fixed entry point propose neighbours for each vector, and pruning keeps one only if no kept
neighbour is nearer to it by the factor ``alpha``, so that edges stay few and point every way. Queries run a beam search in each
shard; the shards' finds are merged. All searches of a block advance together, in array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm.shared import Scratch


@dataclass
class Graph:
    """Unit-ball vectors (one more coordinate makes all lengths equal, so nearest is largest inner product), out-edges (-1: none) and the entry."""

    points: np.ndarray
    edges: np.ndarray
    entry: int


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a coordinate that gives all the same length: among them the nearest is that with the largest inner product."""
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    top = square.max() if len(square) else 0.0
    scale = 1 / np.sqrt(top) if top > 0 else 1.0
    extra = np.sqrt(np.maximum(top - square, 0.0))
    return (np.concatenate((vectors, extra[:, None]), axis=1) * scale).astype(np.float32)


def beam_search(graph: Graph, queries: np.ndarray, beam: int, allowed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, likeness) of the ``beam`` best found for each query, best first; -1 fills up.

    Every round each query opens its best node not opened yet; a query ends when all in its beam are opened. ``allowed`` bounds the nodes in the graph so far.
    """
    m, n = len(queries), len(graph.points) if allowed is None else allowed
    nodes = np.full((m, beam), -1, np.int64)
    score = np.full((m, beam), -np.inf, np.float32)
    opened = np.ones((m, beam), bool)
    if not m or not n:
        return nodes, score
    nodes[:, 0], score[:, 0], opened[:, 0] = graph.entry, queries @ graph.points[graph.entry], False
    seen = np.zeros((m, n), bool)
    seen[:, graph.entry] = True
    live = np.arange(m)
    while len(live):
        pick = (~opened[live]).argmax(axis=1)
        todo = ~opened[live, pick]
        live, pick = live[todo], pick[todo]
        if not len(live):
            break
        opened[live, pick] = True
        near = graph.edges[nodes[live, pick]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        rows, cols = np.nonzero(fresh)
        if not len(rows):
            continue
        to = near[rows, cols]
        seen[live[rows], to] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[rows, cols] = np.einsum("ij,ij->i", queries[live[rows]], graph.points[to])
        both = np.concatenate((score[live], found), axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :beam]
        score[live] = np.take_along_axis(both, order, axis=1)
        nodes[live] = np.take_along_axis(np.concatenate((nodes[live], np.where(fresh, near, -1)), axis=1), order, axis=1)
        opened[live] = np.take_along_axis(np.concatenate((opened[live], ~fresh), axis=1), order, axis=1) | ~np.isfinite(score[live])
    return np.where(np.isfinite(score), nodes, -1), score


def robust_prune(points: np.ndarray, at: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` neighbours for each point of ``at`` out of its row of ``proposed`` (-1: none).

    The nearest goes in; what is nearer to it by ``alpha`` than to the point itself goes out; and so on.
    """
    own = proposed == at[:, None]
    ordered = np.sort(np.where(own, -1, proposed), axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    far = np.where(ordered >= 0, 2 - 2 * np.einsum("ijk,ik->ij", points[ordered], points[at]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    far, ordered = np.take_along_axis(far, order, axis=1), np.take_along_axis(ordered, order, axis=1)
    width = int((ordered >= 0).sum(axis=1).max()) if len(at) else 0
    far, ordered = np.maximum(far[:, :width], 0), ordered[:, :width]
    vectors = points[ordered]
    out = np.full((len(at), degree), -1, np.int64)
    alive = ordered >= 0
    rows = np.arange(len(at))
    for k in range(degree):
        best = alive.argmax(axis=1)
        has = alive[rows, best]
        if not has.any():
            break
        out[has, k] = ordered[rows, best][has]
        between = np.maximum(2 - 2 * np.einsum("ijk,ik->ij", vectors, vectors[rows, best]), 0)
        alive &= ~((alpha * alpha * between <= far) & has[:, None])
        alive[rows, best] = False
    return out


def build(points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, block: int = 1024) -> Graph:
    """The graph of ``points`` (lifted vectors): nodes come in growing blocks, each found by searches in the graph so far, and link back to what they found."""
    n = len(points)
    middle = points.mean(axis=0) if n else np.zeros(0, np.float32)
    order = np.argsort(-(points @ middle), kind="stable")
    order = np.concatenate((order[:1], np.random.default_rng(7).permutation(order[1:])))
    pts = points[order]
    graph = Graph(pts, np.full((n, degree), -1, np.int64), 0)
    done = min(n, 1)
    while done < n:
        fresh = np.arange(done, min(n, done + min(block, max(16, done))))
        found, _ = beam_search(graph, pts[fresh], beam, done)
        mates = np.full((len(fresh), 8), -1, np.int64)  # the block's own nearest, which no search can find yet
        if len(fresh) > 1:
            near = pts[fresh] @ pts[fresh].T
            np.fill_diagonal(near, -np.inf)
            top = np.argpartition(-near, min(8, len(fresh) - 1) - 1, axis=1)[:, :8]
            mates[:, : top.shape[1]] = fresh[top]
        graph.edges[fresh] = robust_prune(pts, fresh, np.concatenate((found, mates), axis=1), degree, alpha)
        source = np.repeat(fresh, degree)
        target = graph.edges[fresh].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for some in (count <= degree, count > degree):
            if some.any():
                width = int(count[some].max())
                back = np.full((int(some.sum()), width), -1, np.int64)
                c = count[some]
                r = np.repeat(np.arange(len(c)), c)
                back[r, np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)] = source[np.repeat(first[some], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
                mine = nodes[some]
                for a in range(0, len(mine), 2048):
                    have = np.concatenate((graph.edges[mine[a : a + 2048]], back[a : a + 2048]), axis=1)
                    have = np.sort(have, axis=1)
                    have[:, 1:][have[:, 1:] == have[:, :-1]] = -1
                    full = (have >= 0).sum(axis=1) > degree
                    part = mine[a : a + 2048]
                    packed = np.take_along_axis(have, np.argsort(have < 0, axis=1, kind="stable"), axis=1)[:, :degree]
                    graph.edges[part[~full]] = packed[~full]
                    if full.any():
                        graph.edges[part[full]] = robust_prune(pts, part[full], have[full], degree, alpha)
        done = int(fresh[-1]) + 1
    edges = np.where(graph.edges >= 0, order[np.maximum(graph.edges, 0)], -1)
    out = np.empty_like(edges)
    out[order] = edges
    return Graph(points, out, int(order[0]) if n else 0)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


SHARD = pa.schema([("dims", pa.int32()), ("shard", pa.int32()), ("node", pa.int32()), ("ids", pa.list_(pa.int64())), ("embedding", pa.list_(pa.float64())), ("edges", pa.list_(pa.int32()))])
FOUND = pa.schema([("qid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _graphs(degree: int):
    """Builds a shard's graph: its vectors in a fixed order, the entry first, each with its out-edges."""

    def run(shard: pa.Table) -> pa.Table:
        base = _matrix(shard["embedding"], len(shard["embedding"][0]))
        graph = build(lifted(base), degree, 2 * degree)
        order = np.r_[graph.entry, np.delete(np.arange(len(base)), graph.entry)]
        place = np.empty(len(base), np.int32)
        place[order] = np.arange(len(base), dtype=np.int32)
        edges = np.where(graph.edges >= 0, place[np.maximum(graph.edges, 0)], -1)[order].astype(np.int32)
        columns = [shard["dims"], shard["shard"], pa.array(np.arange(len(base), dtype=np.int32)), shard["ids"].take(pa.array(order)), shard["embedding"].take(pa.array(order)), pa.FixedSizeListArray.from_arrays(pa.array(edges.ravel()), degree).cast(pa.list_(pa.int32()))]
        return pa.table(columns, schema=SHARD)

    return run


def _visits(k: int, degree: int, beam: int):
    """Searches a shard's stored graph for one block of queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return FOUND.empty_table()
        left = left.sort_by("node")
        of = len(left["embedding"][0])
        base, asks = _matrix(left["embedding"], of), _matrix(right["embedding"], of)
        graph = Graph(lifted(base), _matrix(left["edges"], degree).astype(np.int64), 0)
        ids, number = left["ids"].to_pylist(), right["qid"].to_numpy()
        best = min(len(base), k + 1)
        out = ([], [], [])
        step = max(16, min(2048, (1 << 26) // len(base)))  # a search marks what it has seen: a byte for each query and vector
        for a in range(0, len(asks), step):
            q = asks[a : a + step]
            scaled = np.concatenate((q, np.zeros((len(q), 1))), axis=1)
            scaled = (scaled / np.abs(scaled).max(axis=1, keepdims=True)).astype(np.float32)
            found, _ = beam_search(graph, scaled, beam)
            exact = np.where(found >= 0, np.einsum("ijk,ik->ij", base[found], q), -np.inf)
            order = np.argsort(-exact, axis=1, kind="stable")
            # All that tie with the last one kept stay, so that the smaller ids among them can win.
            score = np.take_along_axis(exact, order, axis=1)
            keep = (score >= score[:, best - 1 : best]) & np.isfinite(score)
            r, c = np.nonzero(keep)
            out[0].extend(number[a + r].tolist())
            out[1].extend(ids[x] for x in np.take_along_axis(found, order, axis=1)[r, c])
            out[2].extend(score[r, c].tolist())
        return pa.table([pa.array(x, f.type) for x, f in zip(out, FOUND, strict=True)], schema=FOUND)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 12_288, most_shards: int = 4096, degree: int = 64, beam: int = 224, query_block: int = 65_536) -> DataFrame:
    """The ``k`` vectors of ``vectors`` (vec_id, embedding) with the largest inner product found for each of ``queries`` (vec_id, embedding), its own vec_id left out.

    Returns query_id, rank (from 1), vec_id and score (the inner product in double precision on the original vectors), nearest first, ties to the smaller vec_id. If there are
    fewer than k candidates, all come back. Equal vectors are indexed once, with their k + 1 smallest ids, which is as many as a result can need. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do null ids; only vectors of the same length meet; equal rows count once; other columns are not read; empty tables give no rows.

    Distinct vectors are dealt by hash to shards of about ``shard_rows``, or more once there are ``most_shards``; each shard's graph is built once and written. Every block of about
    ``query_block`` queries visits every shard, as a task that holds that shard's graph and that block.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    e = F.col("embedding")

    def clean(df: DataFrame) -> DataFrame:
        return df.where("vec_id is not null").where(usable(e)).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"))

    rows = clean(vectors)
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    # The limit on a rank is applied before the shuffle too: of a vector that fills the table every task sends k + 1 rows.
    groups = rows.withColumn("rank", place).where(F.col("rank") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    groups = scratch.keep(groups, "groups")
    shards = min(most_shards, max(1, -(-groups.count() // shard_rows)))
    dims = F.size("embedding")
    dealt = groups.select(dims.alias("dims"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), "ids", "embedding")
    schema = "dims int, shard int, node int, ids array<long>, embedding array<double>, edges array<int>"
    graphs = scratch.keep(dealt.groupBy("dims", "shard").applyInArrow(_graphs(degree), schema), "graphs")
    scratch.drop("groups")
    # Equal queries are searched once, under a number; a common one's own join is split where it is large.
    asked = scratch.keep(clean(queries).select("embedding").distinct().select(F.monotonically_increasing_id().alias("qid"), "embedding"), "asked")
    askers = scratch.keep(clean(queries).distinct().join(asked, "embedding").select("qid", F.col("vec_id").alias("query_id")), "askers")
    blocks = max(1, -(-asked.count() // query_block))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    visits = asked.select(dims.alias("dims"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), "qid", "embedding").select("*", every(shards, "shard"))
    keys = ["dims", "shard", "block"]
    found = graphs.select("*", every(blocks, "block")).groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_visits(k, degree, beam), "qid long, ids array<long>, score double")
    found = found.select("qid", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = scratch.keep(found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k + 1).drop("rank"), "found")
    scratch.drop("graphs", "asked")
    each = askers.join(found, "qid").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
