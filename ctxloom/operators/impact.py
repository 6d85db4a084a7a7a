"""Who is touched by a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.operators.graph import neighbors


def impact(nodes: DataFrame, edges: DataFrame, start: DataFrame, callers: int = 40, cross: int = 20) -> DataFrame:
    """(id, role, depth): callers by calls and injections two steps back, what handlers and API calls connect across repositories, and tests."""
    role = lambda df, r, n: df.select("id", F.lit(r).alias("role"), "depth").orderBy("depth", "id").limit(n)
    a = neighbors(nodes, edges, start, ("calls", "injects"), "in", 2)
    b = neighbors(nodes, edges, start, ("handles", "calls_api"), "both", 2)
    c = neighbors(nodes, edges, start, ("tests",), "in", 1)
    return role(a, "caller", callers).unionByName(role(b, "cross", cross)).unionByName(role(c, "test", callers))


def impact_flat(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """One list over all four kinds, both ways, ``depth`` steps."""
    return neighbors(nodes, edges, start, ("calls", "injects", "calls_api", "handles"), "both", depth)
