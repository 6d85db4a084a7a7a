"""Ranking of nodes for a task, and packing the best into a token budget."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import text as X
from ctxloom.operators.graph import degree_centrality, personalized_pagerank
from ctxloom.operators.history import cochange_scores
from ctxloom.operators.search import NODE_WEIGHTS, bm25

WEIGHTS = {"alpha": 0.7, "beta": 0.5, "gamma": 0.3, "delta": 0.4, "epsilon": 0.2}


@dataclass
class PackOptions:
    budget: int = 4000
    seed_limit: int = 12
    candidate_limit: int = 120
    min_score_ratio: float = 0.08
    min_relevance: float = 0.02
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


def score_columns(weights: dict[str, float] = WEIGHTS):
    """The score of a row with bm25, ppr, centrality, cochange, recency and kind."""
    w = {k: F.lit(float(v)) for k, v in weights.items()}
    total = w["alpha"] * F.col("bm25") + w["beta"] * F.col("ppr") + w["epsilon"] * F.col("centrality") + w["delta"] * F.col("cochange") + w["gamma"] * F.col("recency")
    return total * X.kind_prior("kind")


def why_column(weights: dict[str, float] = WEIGHTS):
    """What each term gives, rounded to two places; ppr and the prior always, others if positive."""
    w = {k: float(v) for k, v in weights.items()}
    terms = {"bm25": w["alpha"], "ppr": w["beta"], "central": w["epsilon"], "cochange": w["delta"], "recency": w["gamma"]}
    of = {"central": "centrality"}
    m = F.create_map(*(x for k, v in terms.items() for x in (F.lit(k), F.round(F.lit(v) * F.col(of.get(k, k)), 2))), F.lit("prior"), F.round(X.kind_prior("kind").cast("double"), 2))
    return F.map_filter(m, lambda k, v: k.isin("ppr", "prior") | (v > 0))


def rank_nodes(nodes: DataFrame, edges: DataFrame, hits: DataFrame, now: int, options: PackOptions | None = None) -> DataFrame:
    """The candidates for ``hits`` (id, score of a search): id, kind, score, terms and why, best first, ties to the smaller id.

    Relevance comes first: a node that neither matched nor has a rank of ``min_relevance`` of the best is left out whatever else speaks for it.
    """
    o = options or PackOptions()
    seeds = [r["id"] for r in hits.orderBy(F.desc("score"), "id").limit(o.seed_limit).collect()]
    top = F.broadcast(hits.agg(F.max("score").alias("top")))
    bm = hits.crossJoin(top).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.lit(0.0)).alias("bm25"))  # top is one row
    ranks = personalized_pagerank(nodes, edges, seeds)
    best = F.broadcast(ranks.agg(F.greatest(F.max("rank"), F.lit(1e-6)).alias("best")))
    ppr = ranks.crossJoin(best).select("id", (F.col("rank") / F.col("best")).alias("ppr"))  # best is one row
    spark = nodes.sparkSession
    seed_rows = spark.createDataFrame([(s,) for s in seeds], "id string")
    co = cochange_scores(seed_rows, edges).withColumnRenamed("score", "cochange")
    rows = nodes.join(bm, "id", "left").join(ppr, "id", "left").fillna(0.0, ["bm25", "ppr"]).where((F.col("bm25") > 0) | (F.col("ppr") >= o.min_relevance))
    rows = rows.join(degree_centrality(nodes, edges).select("id", "centrality"), "id", "left").join(co, "id", "left").fillna(0.0, ["centrality", "cochange"])
    rows = rows.withColumn("recency", X.recency("mtime", now))
    rows = rows.withColumn("score", score_columns(o.weights)).withColumn("why", why_column(o.weights))
    return rows.orderBy(F.desc("score"), "id").limit(o.candidate_limit)


def item_json(row: dict, tier: str, text: str) -> dict:
    item = {"id": row["id"], "kind": row["kind"], "name": row["name"], "ref": row["ref"], "tier": tier, "score": round(row["score"], 4), "signature": row.get("signature"), "tokens": 0}
    if tier != "L0":
        item["doc"], item["text"] = row.get("doc"), text
    return {k: v for k, v in item.items() if v not in (None, "")}


def token_estimate(text: str) -> int:
    return math.ceil(len(text) / X.CHARS_PER_TOKEN)


def greedy_pack(rows: list[dict], options: PackOptions) -> tuple[list[dict], list[str], int]:
    """(items, stale ids, tokens) of the ordered candidates: a fold over at most ``candidate_limit`` rows.

    Rows: id, kind, name, repo, path, score, ref, lines (the whole body, None if it can't be read) and stale. It stops at the budget or
    below ``min_score_ratio`` of the best; a file is left out once a symbol of it is in; an item goes in at the richest tier that fits.
    """
    items, stale, used, bodies, taken = [], [], 0, 3, set()
    top = rows[0]["score"] if rows else 0.0
    for at, row in enumerate(rows):
        if used >= options.budget or row["score"] < options.min_score_ratio * top:
            break
        if row["kind"] not in ("symbol", "file", "route") or row["kind"] == "file" and (row["repo"], row["path"]) in taken:
            continue
        if row.get("stale"):
            stale.append(row["id"])
            continue
        lines = row.get("lines")
        tier = "L2" if at < bodies and lines is not None else "L1" if row["score"] > 0.15 else "L0"
        while tier:
            cap = {"L2": 400, "L1": 15, "L0": 0}[tier]
            item = item_json(row, tier, "\n".join((lines or [])[:cap]))
            cost = token_estimate(json.dumps(item, ensure_ascii=False))
            if used + cost <= options.budget:
                item["tokens"] = cost
                items.append(item)
                used += cost
                bodies -= tier == "L2"
                if row["kind"] == "symbol":
                    taken.add((row["repo"], row["path"]))
                break
            tier = {"L2": "L1", "L1": "L0", "L0": ""}[tier]
    return items, stale, used


def related(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, repos: list[str], limit: int = 8) -> DataFrame:
    """Over API calls and handlers to other repositories: (id, via, repo), each once; what is in ``repos`` already is skipped unless it is a route."""
    hop = edges.where(F.col("kind").isin("calls_api", "handles")).select(F.col("src").alias("at"), F.col("dst").alias("to"), F.upper("kind").alias("via"))
    first = seeds.select(F.col("id").alias("at")).join(hop, "at").select(F.col("to").alias("id"), "via")
    second = first.select(F.col("id").alias("at")).join(hop.where("via = 'HANDLES'"), "at").select(F.col("to").alias("id"), "via")
    found = first.unionByName(second).distinct().join(nodes.select("id", "kind", "repo"), "id")
    return found.where((F.col("kind") == "route") | ~F.col("repo").isin(*repos)).select("id", "via", "repo").distinct().orderBy("id", "via").limit(limit)


def pack(nodes: DataFrame, edges: DataFrame, files: DataFrame, task: str, now: int, options: PackOptions | None = None, synonyms: dict[str, list[str]] | None = None) -> dict:
    """The context pack for a task: items, stale, related, tokens and, if nothing matched, a hint.

    ``files`` (repo, path, content_hash, text) is the present state of the sources; an item whose file is gone or has another hash is stale. At most ``candidate_limit`` rows
    with their bodies come to the driver, where the budget is spent in order.
    """
    o = options or PackOptions()
    query = expand(task, synonyms or {})
    hits = bm25(nodes.withColumn("tokens", X.index_tokens("name", "path")), "id", NODE_WEIGHTS, query, o.seed_limit)
    if hits.isEmpty():
        hint = "No match. The task is not in English; add its terms to semantic.terms." if not task.isascii() and not synonyms else "No match. Try names that occur in the code."
        return {"task": task, "items": [], "stale": [], "related": [], "tokens": 0, "hint": hint}
    ranked = rank_nodes(nodes, edges, hits, now, o)
    hashes = nodes.where("kind = 'file'").select("repo", "path", F.col("content_hash").alias("indexed"))
    state = files.select("repo", "path", F.col("content_hash").alias("present"), "text")
    rows = ranked.join(hashes, ["repo", "path"], "left").join(state, ["repo", "path"], "left").orderBy(F.desc("score"), "id")
    body = F.when(F.col("text").isNotNull(), F.when(F.col("start_line").isNull(), F.split("text", "\n")).otherwise(F.slice(F.split("text", "\n"), F.col("start_line"), F.greatest(F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(400)), F.lit(0)))))
    stale = F.col("path").isNotNull() & (F.col("present").isNull() | (F.col("indexed").isNotNull() & (F.col("indexed") != F.col("present"))))
    got = [r.asDict() for r in rows.select("id", "kind", "name", "repo", "path", "score", "signature", "doc", X.reference("path", "start_line", "end_line").alias("ref"), F.slice(body, 1, 400).alias("lines"), stale.alias("stale")).collect()]
    items, gone, used = greedy_pack(got, o)
    seeds = nodes.sparkSession.createDataFrame([(i["id"],) for i in items] or [("",)], "id string")
    repos = sorted({r["repo"] for r in got if r["id"] in {i["id"] for i in items} and r["repo"]})
    return {"task": task, "items": items, "stale": gone, "related": [r.asDict() for r in related(nodes, edges, seeds, repos or [""]).collect()], "tokens": used, "hint": None}


def expand(query: str, synonyms: dict[str, list[str]]) -> str:
    import re

    words: set[str] = set()
    for w in query.split():
        words.add(w)
        words.update(synonyms.get(w.lower(), []))
        pieces = [p for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|[_\-./ ]+", w) if len(p.encode()) > 1]
        if len(pieces) > 1:
            words.update(pieces)
    return " ".join(sorted(words))


def render_pack(p: dict) -> str:
    rows = [f"{i['tier']:3} {i['score']:.3f} {i['tokens']:5d}  {i.get('ref') or i['id']}" for i in p["items"]]
    return "\n".join([f"pack: {p['task']} ({p['tokens']} tokens)", *rows, *(f"stale: {s}" for s in p["stale"]), *(f"related: {r['id']} via {r['via']}" for r in p["related"]), *([p["hint"]] if p["hint"] else [])])
