"""The engine's front: index source trees into a store, and ask it."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.functions import text as X
from ctxloom.operators import drift as D
from ctxloom.operators import graph as G
from ctxloom.operators import history as H
from ctxloom.operators import rank as P
from ctxloom.operators import resolve as R
from ctxloom.operators import search as S
from ctxloom.operators import store as W
from ctxloom.operators.impact import impact
from ctxloom.sources import files as FS
from ctxloom.sources.extract import FACTS, extract_files
from ctxloom.sources.framework import mapper_statements
from ctxloom.sources.rules import merged

FRAMEWORK = """struct<routes:array<struct<method:string,path:string,handler:string,owner:string>>,beans:array<struct<bean:string,stereotype:string>>,injects:array<struct<owner:string,type:string>>,
entities:array<struct<entity:string,table:string>>,table_refs:array<struct<owner:string,table:string,verb:string>>,api_calls:array<struct<method:string,path:string,dynamic:boolean,described:string,line:int,template:array<struct<tag:string,value:string>>>>,string_constants:map<string,string>>"""


#: The extraction cache: what a text in a language gives under a set of rules.
CACHE_KEYS = ("content_hash", "lang", "rules")
CACHE = f"content_hash string, lang string, rules string, payload struct<{FACTS}, framework string>, bytes bigint, used_at bigint"


def cached_facts(live: DataFrame, cache: DataFrame, rules: dict, now: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, new cache, hits, misses) of ``live`` files: only files whose (hash, language, rules) the cache lacks are parsed."""
    key = hashlib.sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()
    hits, misses, renewed = D.cache_lookup(live.withColumn("rules", F.lit(key)), cache, now, CACHE_KEYS)
    parts = [f.name for f in cache.schema["payload"].dataType.fields]
    fresh = extract_files(misses, rules).select("repo", "path", "lang", F.struct(*parts).alias("payload")).persist()
    facts = hits.select("repo", "path", "lang", "payload").unionByName(fresh).select("repo", "path", "lang", "payload.*")
    put = D.cache_put(renewed, fresh.join(misses.select("repo", "path", "content_hash", "rules"), ["repo", "path"]), now, CACHE_KEYS)
    return facts, put, hits, misses


def build_graph(spark: SparkSession, files: DataFrame, commits: DataFrame | None = None, config: FS.Config | None = None, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of scanned ``files`` (see sources.files.SCAN) and ``commits`` (see history.parse_log); ``facts`` are those of the files, if they are known.

    One narrow pass extracts nested facts, which are kept; all links are joins over them.
    """
    c = config or FS.Config()
    rules = merged(c.framework)
    live = files.where("skipped is null").persist()
    facts = (extract_files(live, rules) if facts is None else facts).withColumn("fw", F.from_json("framework", FRAMEWORK)).withColumn("file", X.node_id("file", "repo", "path")).persist()
    empty = lambda k: F.lit(None).cast(k)

    def node(df: DataFrame, id_, kind: str, name, repo="repo", path=None, start=None, end=None, signature=None, doc=None, lang=None, content_hash=None, mtime=None, attrs=None) -> DataFrame:
        pick = lambda x, k: empty(k) if x is None else X._c(x).cast(k)
        path_ = pick(path, "string")
        return df.select(id_.alias("id"), F.coalesce(F.lower(path_), X._c(name)).alias("key"), F.lit(kind).alias("kind"), X._c(name).alias("name"), X._c(repo).alias("repo"), path_.alias("path"), pick(start, "int").alias("start_line"), pick(end, "int").alias("end_line"), pick(signature, "string").alias("signature"), pick(doc, "string").alias("doc"), pick(lang, "string").alias("lang"), pick(content_hash, "string").alias("content_hash"), pick(mtime, "bigint").alias("mtime"), pick(attrs, "string").alias("attrs"))

    base = F.element_at(F.split("path", "/"), -1)
    nodes = [node(live, X.node_id("file", "repo", "path"), "file", base, path="path", start=F.lit(1), end=X.line_count("text"), lang="lang", content_hash="content_hash", mtime="mtime", attrs=F.to_json(F.struct("bytes"))), node(live.select("repo").distinct(), X.node_id("repo", "repo"), "repo", "repo")]
    beans = facts.select("file", F.explode("fw.beans").alias("b")).select("file", F.col("b.bean").alias("name"), F.col("b.stereotype").alias("bean"))
    syms = facts.select("repo", "path", "lang", "file", F.explode("symbols").alias("s")).select("repo", "path", "lang", "file", "s.*")
    syms = syms.withColumn("id", F.when(F.col("partial"), X.node_id("partial", "repo", "name")).otherwise(X.node_id("sym", "repo", "path", "name"))).join(beans, ["file", "name"], "left").persist()
    nodes.append(node(syms, F.col("id"), "symbol", "name", path="path", start="start_line", end="end_line", signature="signature", doc="doc", lang="lang", attrs=F.to_json(F.struct(F.col("kind").alias("symbol_kind"), F.col("bean").alias("spring_stereotype")))))
    own = syms.select(F.col("file").alias("o_file"), F.col("name").alias("o_name"), F.col("id").alias("o_id")).distinct()
    of = lambda df, name: df.join(own, (F.col("file") == F.col("o_file")) & (F.col(name) == F.col("o_name")))
    routes = facts.select("repo", "path", "file", F.explode("fw.routes").alias("r")).select("repo", F.col("path").alias("in_path"), "file", "r.*").withColumn("id", X.node_id("route", "method", "path")).persist()
    nodes.append(node(routes, F.col("id"), "route", F.concat_ws(" ", "method", "path"), path="in_path"))
    api = facts.select("repo", "path", "file", F.posexplode("fw.api_calls").alias("k", "c")).select("repo", F.col("path").alias("in_path"), "file", "k", "c.*").withColumn("id", X.node_id("api", "repo", "in_path", "line", "k")).persist()
    constants = facts.select(F.explode("fw.string_constants").alias("name", "value"))
    filled = R.fill_urls(api.select("id", F.col("template").alias("parts")), constants)
    calls = api.drop("path", "dynamic").join(filled, "id").persist()
    nodes.append(node(calls, F.col("id"), "api_call", F.concat_ws(" ", "method", "path"), path="in_path", start="line", end="line", attrs=F.to_json(F.struct("dynamic", "described"))))
    xml = live.where("lang = 'xml'").select("repo", "path", "text")
    stmts = _mapper_rows(xml).withColumn("file", X.node_id("file", "repo", "path")).withColumn("id", X.node_id("sym", "repo", "path", "name")).persist()
    nodes.append(node(stmts, F.col("id"), "symbol", "name", path="path", start="start_line", end="end_line", lang=F.lit("xml"), attrs=F.to_json(F.struct("namespace"))))
    e = [R.structural_edges(live.select("repo", X.node_id("file", "repo", "path").alias("id")), syms.select("file", "id").unionByName(stmts.select("file", "id")), calls.select("file", "id"))]
    sites = facts.select("file", F.explode("calls").alias("c")).select("file", "c.callee", "c.line")
    sites = R.enclosing_symbols(sites, syms.select("file", "id", "start_line", "end_line")).select(F.col("enclosing").alias("src"), "callee").persist()
    e.append(R.call_edges(R.resolve_calls(sites, syms.select("id", "name"), c.max_candidates)))
    imports = R.resolve_imports(facts.select("file", "path", "lang", F.explode("imports").alias("spec")).distinct(), live.select(X.node_id("file", "repo", "path").alias("id"), "path")).persist()
    e.append(imports.select("file", "dst", "kind").distinct().select(F.col("file").alias("src"), "dst", "kind", F.lit("fast").alias("provenance"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("weight")))
    deps = imports.where("kind = 'depends_on'").select("dst").distinct()
    nodes.append(node(deps, F.col("dst"), "external_dep", F.substring("dst", 5, 10_000), repo=F.lit("")))
    linked = R.link_api_calls(calls.select("id", "method", "path", "dynamic"), routes.select("id", "method", "path")).where("dst is not null")
    e.append(linked.select(*R.edge("id", "dst", "calls_api", F.col("confidence"))))
    supers = facts.select("file", F.explode("supertypes").alias("s")).select("file", "s.*").persist()
    e.append(R.supertype_edges(of(supers, "sub").select(F.col("o_id").alias("id"), "super"), syms.select("id", "name")))
    injects = of(facts.select("file", F.explode("fw.injects").alias("i")).select("file", "i.*"), "owner").select(F.col("o_id").alias("owner"), "type")
    e.append(R.inject_edges(injects, syms.select("id", "name"), supers.select("sub", "super")))
    e.append(R.test_edges(syms.select("id", "name", "kind", "path"), sites))
    e.append(R.handle_edges(of(routes.select("file", F.col("id").alias("route"), "handler"), "handler").select(F.col("route").alias("id"), F.col("o_id").alias("handler"))))
    entities = of(facts.select("file", F.explode("fw.entities").alias("x")).select("file", "x.*"), "entity").select(F.col("o_id").alias("id"), F.col("entity").alias("name"), "table")
    refs = of(facts.select("file", F.explode("fw.table_refs").alias("x")).select("file", "x.*"), "owner").select(F.col("o_id").alias("id"), "table", F.lit("annotation").alias("source"))
    refs = refs.unionByName(stmts.select("id", F.explode("tables").alias("table"), F.lit("xml").alias("source")))
    persists = R.persist_edges(entities, refs).persist()
    nodes.append(node(persists.select("dst").distinct(), F.col("dst"), "table", F.substring("dst", 7, 10_000), repo=F.lit("")))
    e.append(persists)
    if commits is not None:
        k = commits.withColumn("id", X.node_id("commit", "repo", "sha")).withColumn("who", X.node_id("author", "email")).persist()
        nodes.append(node(k, F.col("id"), "commit", "subject", mtime="epoch"))
        nodes.append(node(H.authors(commits), X.node_id("author", "email"), "author", "name", repo=F.lit("")))
        changes = k.select(F.explode("files").alias("f"), "repo", "id").select(X.node_id("file", "repo", "f").alias("file"), F.col("id").alias("commit"))
        e += [H.modified_by(changes), k.select(*R.edge("id", "who", "authored_by", 1.0, "precise")).distinct(), H.cochange_edges(H.cochange_pairs(changes))]
    every, links = nodes[0], e[0]
    for x in nodes[1:]:
        every = every.unionByName(x)
    for x in e[1:]:
        links = links.unionByName(x.select(*links.columns))
    every = W.last_rows(every, ["id"], F.struct("kind", "path", "start_line"))
    links = links.groupBy("src", "dst", "kind").agg(F.max("provenance").alias("provenance"), F.max("confidence").alias("confidence"), F.max("weight").alias("weight"))
    ids = every.select("id")
    links = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return W.prune_orphans(every, links)


def _mapper_rows(xml: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(r, p, s["id"], s["namespace"], s["start_line"], s["end_line"], [t["table"] for t in s["tables"]]) for r, p, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for s in mapper_statements(t or "")]
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["repo", "path", "name", "namespace", "start_line", "end_line", "tables"])

    return xml.mapInArrow(run, "repo string, path string, name string, namespace string, start_line int, end_line int, tables array<string>")


class ContextGraph:
    """An index below ``root`` and the questions it answers; each answer is a DataFrame, a pack a dictionary."""

    def __init__(self, spark: SparkSession, root: str, config: FS.Config):
        self.spark, self.config, self.store = spark, config, W.Store(spark, root)
        self.freshness = D.Throttle(lambda: self.drift().first().asDict())

    def repos(self) -> dict[str, str]:
        return {Path(r).name or "repo": r for r in self.config.repos}

    def scan(self) -> DataFrame:
        parts = [FS.scan_tree(self.spark, name, root, self.config.exclude, self.config.max_file_bytes) for name, root in self.repos().items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.where(F.col("lang").isin(*self.config.languages) | ~F.col("lang").isin(*X.CODE)) if self.config.languages else out

    def index(self) -> dict:
        """Scans, extracts, links and writes a new snapshot; returns its metrics."""
        began = time.time()
        logs = [H.parse_log(FS.git_log(self.spark, root, self.config.max_commits), name) for name, root in self.repos().items()]
        commits = logs[0]
        for x in logs[1:]:
            commits = commits.unionByName(x)
        files = self.scan().persist()
        live = files.where("skipped is null")
        facts, cache, hits, misses = cached_facts(live, self.store.cache(CACHE), merged(self.config.framework), int(began))
        n_hits, n_misses = hits.count(), misses.count()
        nodes, edges = build_graph(self.spark, files, commits, self.config, facts)
        nodes, edges = nodes.persist(), edges.persist()
        kinds = lambda df: {r["kind"]: r["n"] for r in df.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        skipped = {r["skipped"]: r["n"] for r in files.where("skipped is not null").groupBy("skipped").agg(F.count("*").alias("n")).collect()}
        languages = {r["lang"]: r["n"] for r in D.files_by_language(nodes).collect()}
        coverage = {r["lang"]: [r["files"], r["parsed"], r["mark"]] for r in D.language_coverage(facts.where(F.col("lang").isin(*X.CODE))).collect()}
        api_calls = nodes.where("kind = 'api_call'").select("id", (F.get_json_object("attrs", "$.dynamic") == "true").alias("dynamic"))
        linked = edges.where("kind = 'calls_api'").select(F.col("src").alias("id")).distinct().withColumn("hit", F.lit(1))
        calls = api_calls.join(linked, "id", "left").agg(F.count("*").alias("all"), F.count("hit").alias("linked"), F.count_if("dynamic").alias("dynamic")).first().asDict()
        metrics = {"nodes": kinds(nodes), "edges": kinds(edges), "files": languages, "coverage": coverage, "api_calls": calls, "cache": {"hits": n_hits, "misses": n_misses, "rate": round(D.hit_rate(n_hits, n_misses), 4)}, "skipped": skipped, "repos": {n: dict(zip(("branch", "head"), FS.git_head(r), strict=True)) for n, r in self.repos().items()}, "seconds": round(time.time() - began, 2)}
        self.store.write(nodes, edges, metrics, D.cache_evict(cache, self.config.cache_bytes))
        for kept in (files, nodes, edges):
            kept.unpersist()
        self.freshness.forget()
        return metrics

    def search(self, query: str, limit: int = 20) -> DataFrame:
        nodes = self.store.nodes().withColumn("tokens", X.index_tokens("name", "path"))
        hits = S.bm25(nodes, "id", S.NODE_WEIGHTS, P.expand(query, self.config.terms), limit)
        return hits.join(self.store.nodes(), "id").select("id", "kind", "name", "repo", X.reference("path", "start_line", "end_line").alias("ref"), "score").orderBy(F.desc("score"), "id")

    def neighbors(self, node: str, kinds: tuple[str, ...] = (), direction: str = "both", depth: int = 1) -> DataFrame:
        kinds = tuple(k for k in kinds if k in W.EDGE_KINDS)
        return G.neighbors(self.store.nodes(), self.store.edges(), self._one(node), kinds, direction, depth).join(self.store.nodes(), "id")

    def paths(self, start: str, end: str, most: int = 6) -> DataFrame:
        return G.shortest_path(self.store.edges(), start, end, most)

    def rank(self, query: str, now: int | None = None) -> DataFrame:
        nodes = self.store.nodes()
        hits = S.bm25(nodes.withColumn("tokens", X.index_tokens("name", "path")), "id", S.NODE_WEIGHTS, P.expand(query, self.config.terms), 12)
        return P.rank_nodes(nodes, self.store.edges(), hits, now or int(time.time()), P.PackOptions(weights=self.config.rank))

    def pack(self, task: str, budget: int = 4000, now: int | None = None) -> dict:
        """A pack for ``task``; if files have changed since they were indexed, stale_index says how many."""
        found = P.pack(self.store.nodes(), self.store.edges(), self.scan(), task, now or int(time.time()), P.PackOptions(budget=budget, weights=self.config.rank), self.config.terms)
        return D.with_stale_note(found, self.freshness.get())

    def impact(self, node: str) -> DataFrame:
        return impact(self.store.nodes(), self.store.edges(), self._one(node)).join(self.store.nodes(), "id")

    def drift(self) -> DataFrame:
        old = self.store.nodes().where("kind = 'file'").select("repo", "path", "content_hash", "mtime", F.get_json_object("attrs", "$.bytes").cast("bigint").alias("bytes"))
        return D.drift(old.where(F.col("repo").isin(*self.repos())), self.scan().where("skipped is null"))

    def doctor(self) -> DataFrame:
        """Counts of nodes and edges by kind, files by language, and the share of API calls that reach a route."""
        rows = lambda df, what: df.select(F.lit(what).alias("what"), F.col(df.columns[0]).cast("string").alias("of"), F.col("n").cast("double").alias("n"))
        nodes, edges = self.store.nodes(), self.store.edges()
        count = lambda df: df.groupBy("kind").agg(F.count("*").alias("n"))
        calls = nodes.where("kind = 'api_call'").where(F.get_json_object("attrs", "$.dynamic") == "false")
        share = calls.join(edges.where("kind = 'calls_api'").select(F.col("src").alias("id")).distinct().withColumn("hit", F.lit(1)), "id", "left").agg(F.coalesce(100 * F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("n")).select(F.lit("linked %").alias("of"), "n")
        return rows(count(nodes), "nodes").unionByName(rows(count(edges), "edges")).unionByName(rows(D.files_by_language(nodes), "files")).unionByName(rows(share, "api calls"))

    def bench(self, tasks: DataFrame, budget: int = 4000) -> DataFrame:
        """Tokens of packs against those of the whole files that a wide search hits, and recall of what tasks expect."""
        sizes = {(r["repo"], r["path"]): r["n"] for r in self.scan().where("skipped is null").select("repo", "path", X.estimate_tokens("text").alias("n")).collect()}
        rows = []
        for t in tasks.collect():
            p = self.pack(t["task"], budget)
            plain = {(r["repo"], r["path"]) for r in self.search(t["task"], 40).join(self.store.nodes().select("id", "path"), "id").select("repo", "path").collect()}
            rows.append((t["task"], p["tokens"], int(sum(sizes.get(x, 0) for x in plain)), list(t["expect"]), [i.get("ref") or i["id"] for i in p["items"]]))
        return D.bench_summary(self.spark.createDataFrame(rows, "task string, packed long, plain long, expected array<string>, refs array<string>"))

    def watch(self, changes: DataFrame, checkpoint: str):
        """Indexes anew whenever the stream ``changes`` (path) brings something."""
        from ctxloom.streaming.watch import watch

        return watch(changes, lambda paths, number: self.index(), checkpoint)

    def _one(self, node: str) -> DataFrame:
        return self.spark.createDataFrame([(node,)], "id string")
