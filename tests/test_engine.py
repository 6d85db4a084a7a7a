"""The engine over a small source tree, and operators against independent versions."""

import json
import math
import random
import re
import sqlite3
import subprocess
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom.api import CACHE, ContextGraph, cached_facts
from ctxloom.cli import main
from ctxloom.functions import text as X
from ctxloom.operators import drift as D
from ctxloom.operators import graph as G
from ctxloom.operators import history as H
from ctxloom.operators import rank as P
from ctxloom.operators import resolve as R
from ctxloom.operators import search as S
from ctxloom.operators import store as W
from ctxloom.sources import files as FS
from ctxloom.sources.rules import merged
from ctxloom.streaming.watch import changed_paths, debounced, watch


def one(spark, column, **values):
    kinds = {str: "string", int: "long", list: "array<string>", dict: "map<string,array<string>>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "words"), [("getUserName", ["get", "User", "Name"]), ("snake_case-kebab", ["snake", "case", "kebab"]), ("HTTPServer", ["HTTPServer"]), ("v2Api", ["v2", "Api"]), ("aB", [])])
def test_split_identifier(spark, name, words):
    assert one(spark, X.split_identifier("s"), s=name) == words


@pytest.mark.parametrize(("raw", "path"), [("/a/{id}", "/a/{}"), ('"/a/${id}/b/"', "/a/{}/b"), ("a/:x", "/a/{}"), ("", "/"), ("/", "/"), ("//", "/")])
def test_route_path(spark, raw, path):
    assert one(spark, X.route_path("s"), s=raw) == path
    assert one(spark, X.route_path(X.route_path("s")), s=raw) == path


@pytest.mark.parametrize(("base", "spec", "path"), [("a/b/c.ts", "./d", "a/b/d"), ("a/b/c.ts", "../d", "a/d"), ("c.ts", "./d", "d"), ("c.ts", "../d", None)])
def test_fold_relative(spark, base, spec, path):
    assert one(spark, X.fold_relative("b", "s"), b=base, s=spec) == path


def test_text_functions(spark):
    assert one(spark, X.tables_in_sql("s"), s="DELETE FROM a.cart JOIN x1 ON fromage") == [("cart", "select"), ("x1", "select"), ("cart", "delete")]
    assert one(spark, X.index_tokens("n", "p"), n="UserSvc", p="a/b/user_svc.py") == "Svc User py svc user"
    assert one(spark, X.index_tokens("n", "p"), n="main", p="main.rs") == "main rs"
    assert one(spark, X.repo_name("p"), p="C:\\x\\shop\\") == "shop" and one(spark, X.relative_to("p", F.lit("/r")), p="/r/a/b") == "a/b" and one(spark, X.relative_to("p", F.lit("/r")), p="/rx/a") is None
    assert one(spark, X.external_dep("s", F.lit("java")), s="org.x.y.Z") == "org.x" and one(spark, X.external_dep("s", F.lit("typescript")), s="@a/b/c") == "@a/b"
    assert one(spark, X.slice_lines("s", F.lit(2), F.lit(9), 2), s="a\nb\nc\nd") == "b\nc" and one(spark, X.truncate("s", 4), s="abcdef") == "abc…"
    assert one(spark, X.normalize_path("s"), s="\\\\?\\C:\\a\\b") == "C:/a/b"
    assert [one(spark, X.is_test_path("s"), s=p) for p in ("src/test/a.java", "x/test_a.py", "a/b.spec.ts", "src/latest/a.java")] == [True, True, True, False]
    assert one(spark, X.recency(F.lit(0), 30 * 86400), s="") == pytest.approx(0.5)


def test_bm25_equals_sqlite(spark):
    rng = random.Random(1)
    pool = ["alpha", "beta", "gamma", "Über", "x1", "delta", "user_name"]
    rows = [(k, " ".join(rng.choices(pool, k=rng.randrange(1, 6))), " ".join(rng.choices(pool, k=rng.randrange(0, 30)))) for k in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(name, doc, tokenize='unicode61')")
    db.executemany("insert into t(rowid, name, doc) values (?, ?, ?)", rows)
    for q in ("alpha uber", "user_name gamma", 'x1 "beta*'):
        words = " OR ".join('"' + w.replace('"', "") + '"' for w in q.split())
        want = dict(db.execute("select rowid, -bm25(t, 10.0, 2.0) from t where t match ?", (words,)).fetchall())
        got = {r["id"]: r["score"] for r in S.bm25(spark.createDataFrame(rows, "k long, name string, doc string"), "k", {"name": 10.0, "doc": 2.0}, q, 1000).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert S.bm25(spark.createDataFrame(rows, "k long, name string, doc string"), "k", {"name": 1.0}, ' "* ', 5).count() == 0


@given(st.integers(2, 12), st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_rank_mass(n, seed):
    rng = np.random.default_rng(seed)
    src, dst = np.arange(n - 1), np.arange(1, n)
    r = G.pagerank_kernel([str(k) for k in range(n)], np.r_[src, rng.integers(0, n, 3)], np.r_[dst, rng.integers(0, n, 3)], np.ones(n + 2), ["0"], 0.5, 25)
    assert r.sum() == pytest.approx(1)


def test_rank_of_a_path(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("alone",)], "id string")
    edges = spark.createDataFrame([("a", "b", "calls", 1.0, 1.0), ("b", "c", "calls", 1.0, 1.0), ("c", "gone", "calls", 1.0, 1.0)], "src string, dst string, kind string, confidence double, weight double")
    for bound in (G.KERNEL_EDGES, 0):
        r = {x["id"]: x["rank"] for x in G.personalized_pagerank(nodes, edges, ["a"], rounds=25, kernel_edges=bound).collect()}
        assert (round(r["a"], 3), round(r["b"], 3), round(r["c"], 3), r["alone"]) == (0.583, 0.333, 0.083, 0.0)
    assert {x["rank"] for x in G.personalized_pagerank(nodes, edges, []).collect()} == {0.0}
    # A seed without edges hands its rank to the seeds.
    a, b = ({x["id"]: round(x["rank"], 12) for x in G.personalized_pagerank(nodes, edges, ["a", "alone"], rounds=6, kernel_edges=bound).collect()} for bound in (G.KERNEL_EDGES, 0))
    assert a == b and a["alone"] > 0


def test_upsert_and_prune(spark):
    e = spark.createDataFrame([("a", "b", "calls", "fast", 1.0, 1.0)], W.EDGES)
    more = spark.createDataFrame([("a", "b", "calls", "fast", 0.5, 1.0, 1), ("a", "b", "calls", "fast", 0.7, 1.0, 2), ("x", "y", "calls", "fast", 1.0, 1.0, 3)], W.EDGES + ", seq int")
    once = W.upsert_edges(e, more)
    assert sorted((r["src"], r["confidence"]) for r in once.collect()) == [("a", 0.7), ("x", 1.0)]
    assert sorted(map(tuple, W.upsert_edges(once, more).collect())) == sorted(map(tuple, once.collect()))
    nodes = spark.createDataFrame([("file:1", "file"), ("commit:1", "commit"), ("author:1", "author"), ("repo:r", "repo")], "id string, kind string")
    links = spark.createDataFrame([("commit:1", "author:1")], "src string, dst string")
    assert {r["id"] for r in W.prune_orphans(nodes, links)[0].collect()} == {"file:1", "repo:r"}


def test_packing_keeps_to_the_budget():
    rng = random.Random(3)
    rows = [{"id": f"n{k}", "kind": rng.choice(["symbol", "file", "route", "api_call"]), "name": "n", "repo": "r", "path": f"p{k % 9}", "score": 2 - k / 60, "ref": f"p{k}", "signature": "s" * rng.randrange(90), "doc": None, "lines": ["x" * 20] * rng.randrange(60) if k % 4 else None, "stale": k % 17 == 3} for k in range(110)]
    for budget in (0, 50, 400, 4000):
        items, stale, used = P.greedy_pack(rows, P.PackOptions(budget=budget))
        assert used == sum(i["tokens"] for i in items) <= budget and all(i["kind"] != "api_call" for i in items)
        assert sum(i["tier"] == "L2" for i in items) <= 2
    assert "n3" in stale


def test_log_and_cochange(spark):
    log = "\x00s1\x1fAnn\x1fa@x\x1f100\x1ffirst\n\na.py\nb\\c.py\n\x00s2\x1fAnn B\x1fa@x\x1f200\x1fsecond\n\na.py\nb/c.py\n\x00bad\x1fx\n\x00s3\x1fBob\x1fb@x\x1f300\x1fempty\n"
    commits = H.parse_log(spark.createDataFrame([(log,)], "value string"), "r")
    assert [(r["sha"], r["epoch"], r["files"]) for r in commits.orderBy("sha").collect()] == [("s1", 100, ["a.py", "b/c.py"]), ("s2", 200, ["a.py", "b/c.py"])]
    assert [tuple(r) for r in H.authors(commits).collect()] == [("a@x", "Ann", 2)]
    pairs = H.cochange_pairs(commits.select(F.explode("files").alias("file"), F.col("sha").alias("commit")))
    assert [(r["a"], r["b"], r["n"], round(r["weight"], 6)) for r in pairs.collect()] == [("a.py", "b/c.py", 2, round(math.log(3), 6))]


def test_throttle():
    clock, calls = [0.0], []
    t = D.Throttle(lambda: calls.append(1) or {"changed": 1, "added": 0, "removed": 0}, 60, lambda: clock[0])
    t.get()
    clock[0] = 59
    t.get()
    assert len(calls) == 1
    clock[0] = 60
    assert D.with_stale_note({"a": 1}, t.get())["stale_index"].endswith("1 changed") and len(calls) == 2
    assert D.Throttle(lambda: 1 / 0).get() is None and D.with_stale_note({"a": 1}, None) == {"a": 1}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees")
    back, front = root / "shop", root / "web"
    files = {
        back / "src/main/java/p/UserController.java": 'package p;\nimport p.UserService;\nimport org.lib.Thing;\n@RestController @RequestMapping("/api/users")\npublic class UserController {\n  private final UserService users;\n  public UserController(UserService users) { this.users = users; }\n  @GetMapping("/{id}") public User one(int id) { return users.loadUser(id); }\n}\n',
        back / "src/main/java/p/UserService.java": 'package p;\n/** Loads users. */\n@Service\npublic class UserService {\n  public User loadUser(int id) { return mapper.selectUser(id); }\n}\n@Entity @Table(name = "Users") class User {}\n',
        back / "src/test/java/p/UserServiceTest.java": "package p;\npublic class UserServiceTest { void works() { loadUser(1); } }\n",
        back / "src/main/resources/m.xml": '<mapper namespace="p.M">\n<select id="selectUser">select * from users</select>\n</mapper>\n',
        back / "node_modules/x.js": "function no() {}\n",
        back / "big.py": "x = 1\n" * 400_000,
        front / "src/api.ts": "import { helper } from './helper';\nexport const loadUser = async (id: string) => { return await fetch(API + '/' + id) };\nconst API = '/api/users';\n",
        front / "src/helper.ts": "export function helper() { return 1 }\n",
        front / "bin.py": b"\xff\xfe\x00",
        front / ".gitignore": "ignored.ts\n",
        front / "ignored.ts": "function no() {}\n",
    }
    for p, t in files.items():
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(t if isinstance(t, bytes) else t.encode())
    git = lambda *a: subprocess.run(["git", "-C", str(front), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(2):
        (front / "src/api.ts").open("a").write(f"// {k}\n")
        (front / "src/helper.ts").open("a").write(f"// {k}\n")
        git("add", "-A")
        git("commit", "-qm", f"change {k}")
    FS.save_config(str(root / FS.CONFIG_NAME), FS.Config(repos=[str(back), str(front)], terms={"nutzer": ["user"]}))
    return root


@pytest.fixture(scope="module")
def graph(spark, tree):
    g = ContextGraph(spark, f"file://{tree}/.ctxloom", FS.load_config(str(tree / FS.CONFIG_NAME)))
    g.metrics = g.index()
    return g


def test_index(graph):
    nodes = {r["id"]: r for r in graph.store.nodes().collect()}
    edges = {(r["src"], r["dst"], r["kind"]): r["confidence"] for r in graph.store.edges().collect()}
    java = "shop/src/main/java/p"
    assert {"route:GET /api/users/{}", "table:users", "dep:org.lib", f"sym:{java}/UserController.java#one", "author:a@x", "repo:shop"} <= set(nodes)
    assert not [i for i in nodes if "node_modules" in i or "ignored" in i or "big.py" in i] and graph.metrics["skipped"] == {"size": 1, "binary": 1}
    assert edges[f"sym:{java}/UserController.java#one", f"sym:{java}/UserService.java#loadUser", "calls"] == pytest.approx(0.4)
    assert (f"file:{java}/UserController.java", f"file:{java}/UserService.java", "imports") in edges
    assert (f"file:{java}/UserController.java", "dep:org.lib", "depends_on") in edges
    assert (f"sym:{java}/UserController.java#UserController", f"sym:{java}/UserService.java#UserService", "injects") in edges
    assert (f"sym:{java}/UserService.java#User", "table:users", "persists_to") in edges and ("sym:shop/src/main/resources/m.xml#selectUser", "table:users", "persists_to") in edges
    assert edges["sym:shop/src/test/java/p/UserServiceTest.java#UserServiceTest", f"sym:{java}/UserService.java#UserService", "tests"] == 0.9
    assert ("route:GET /api/users/{}", f"sym:{java}/UserController.java#one", "handles") in edges
    api = [k for k in edges if k[2] == "calls_api"]
    assert len(api) == 1 and api[0][1] == "route:GET /api/users/{}" and edges[api[0]] == 0.9
    assert ("file:web/src/api.ts", "file:web/src/helper.ts", "co_changed_with") in edges and ("file:web/src/api.ts", "file:web/src/helper.ts", "imports") in edges
    assert all(s in nodes and d in nodes for s, d, _ in edges)
    bean = json.loads(nodes[f"sym:{java}/UserService.java#UserService"]["attrs"])
    assert bean["spring_stereotype"] == "Service"


def test_questions(graph, tree):
    hits = graph.search("nutzer service").collect()
    assert "UserService" in hits[0]["name"] and "sym:shop/src/main/java/p/UserService.java#UserService" in {h["id"] for h in hits}
    pack = graph.pack("load user by id", budget=600)
    assert pack["items"] and pack["tokens"] <= 600 and any("loadUser" in i["id"] for i in pack["items"])
    assert "pack:" in P.render_pack(pack) and graph.pack("zzz")["hint"] and not graph.pack("zzz")["items"]
    assert graph.drift().first().asDict() | {"indexed": 0} == {"changed": 0, "added": 0, "removed": 0, "indexed": 0}
    seen = {r["id"]: r["role"] for r in graph.impact("sym:shop/src/main/java/p/UserService.java#loadUser").collect()}
    assert seen["sym:shop/src/main/java/p/UserController.java#one"] == "caller"
    path = graph.paths("file:web/src/api.ts", "sym:shop/src/main/java/p/UserController.java#one").first()["path"]
    assert path[-2] == "route:GET /api/users/{}"
    share = {(r["what"], r["of"]): r["n"] for r in graph.doctor().collect()}
    assert share["api calls", "linked %"] == 100.0
    (tree / "tasks.jsonl").write_text('# comment\n\n{"task": "load user", "expect": ["UserService.java"]}\n{"task": "helper"}\n')
    got = graph.bench(FS.read_tasks(graph.spark, f"file://{tree}/tasks.jsonl"), 2000).first()
    assert got["recall"] == 1.0 and got["packed"] <= 2000


def test_lookups_metadata_and_stale_notes(graph, tree):
    store, path = graph.store, "src/main/java/p/UserService.java"
    node = store.node(f"file:shop/{path}")
    assert node["kind"] == "file" and store.file_hash("shop", path) == node["content_hash"]
    assert store.node("none") is None and store.file_hash("web", path) is None and store.get_meta("a") is None
    store.set_meta("a", "1")
    store.set_meta("b", "2")
    store.set_meta("a", "3")
    assert (store.get_meta("a"), store.get_meta("b")) == ("3", "2") and store.node(f"file:shop/{path}") == node
    (tree / "shop" / "Fresh.java").write_text("class Fresh {}")
    try:
        graph.freshness.forget()
        assert graph.pack("load user by id", budget=600)["stale_index"].endswith("1 added")
    finally:
        (tree / "shop" / "Fresh.java").unlink()
    assert "stale_index" in graph.pack("load user by id", budget=600)  # the measurement still stands
    graph.freshness.forget()
    assert "stale_index" not in graph.pack("load user by id", budget=600)


def test_config_and_cli(tree, tmp_path, capsys, monkeypatch):
    (tree / FS.SHARED_NAME).write_text('[index]\nmax_commits = 7\nmax_file_bytes = 5\n[rank]\nalpha = 1.5\n')
    c = FS.load_config(str(tree / FS.CONFIG_NAME))
    assert (c.max_commits, c.max_file_bytes, c.rank["alpha"], c.rank["beta"]) == (7, FS.MOST_BYTES, 1.5, 0.5)
    (tree / FS.SHARED_NAME).unlink()
    assert FS.find_config(str(tree / "web" / "src")) == str((tree / FS.CONFIG_NAME).resolve())
    monkeypatch.chdir(tmp_path)
    assert main(["init", str(tree / "shop")]) == 0 and FS.load_config(str(tmp_path / FS.CONFIG_NAME)).languages == ["java"]
    with pytest.raises(FileExistsError):
        main(["init", str(tree / "shop")])
    assert main(["rules"]) == 0 and "GetMapping" in capsys.readouterr().out
    with pytest.raises(ValueError, match="bad pattern"):
        FS.Excluded(["a[b"])


def test_schema_gate(spark, tmp_path):
    (tmp_path / "current.json").write_text('{"schema_version": 99, "snapshot": null}')
    with pytest.raises(ValueError, match="rebuild"):
        W.Store(spark, f"file://{tmp_path}").state()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"path": "a.py"}\n{"path": "a.py"}\n{"path": ".git/x"}\n')
    seen = []
    q = watch(spark.readStream.schema("path string").json(f"file://{tmp_path}/in"), lambda df, n: seen.extend(r["path"] for r in df.collect()), f"file://{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert seen == ["a.py"]
    events = spark.createDataFrame([("k", t) for t in (0, 100, 400, 1200)], "k string, ms long").select("k", F.timestamp_millis("ms").alias("at"))
    assert sorted(r["n"] for r in debounced(events, "at", ["k"]).collect()) == [1, 3]
    assert changed_paths(spark.createDataFrame([("a/.git/b",)], "path string")).count() == 0


def test_extraction_cache(spark):
    """A cold pass parses every file, a warm one none, a changed file or other rules those that they touch; the facts are the same."""
    row = lambda path, text: ("r", path, "python", hash_of(text), text)
    hash_of = lambda text: str(zlib.crc32(text.encode()))
    two = "def two():\n    return 1\n"
    rows = [row("a.py", "def one():\n    return two()\n"), row("b.py", two), row("copy.py", two)]
    files = lambda rows: spark.createDataFrame(rows, "repo string, path string, lang string, content_hash string, text string")
    names = lambda facts: sorted((r["path"], [s["name"] for s in r["symbols"]]) for r in facts.collect())
    facts, cache, hits, misses = cached_facts(files(rows), spark.createDataFrame([], CACHE), merged(None), 1)
    cold = names(facts)
    assert (hits.count(), misses.count(), cache.count()) == (0, 3, 2) and cold == [("a.py", ["one"]), ("b.py", ["two"]), ("copy.py", ["two"])]
    cache = spark.createDataFrame(cache.collect(), CACHE)
    facts, again, hits, misses = cached_facts(files(rows), cache, merged(None), 2)
    assert (hits.count(), misses.count(), again.count()) == (3, 0, 2) and names(facts) == cold and {r["used_at"] for r in again.collect()} == {2}
    _, _, hits, misses = cached_facts(files([row("a.py", "def three(): ..."), *rows[1:]]), cache, merged(None), 3)
    assert (hits.count(), misses.count()) == (2, 1)
    _, _, hits, misses = cached_facts(files(rows), cache, merged('[[framework.bean]]\nlang = "java"\nannotations = ["Mine"]\n'), 3)
    assert (hits.count(), misses.count()) == (0, 3)


def test_warm_index(graph):
    """What an earlier index of this tree parsed is not parsed again."""
    metrics = graph.index()
    assert metrics["cache"]["misses"] == 0 and metrics["cache"]["rate"] == 1.0 and metrics["files"] and metrics["coverage"] and metrics["api_calls"]["linked"] > 0


def _shuffles_pairs(df):
    """Whether rows of df are shuffled by both ends, in the plan as it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return any("src#" in x and "dst#" in x or "sub#" in x and "target#" in x or "test#" in x and "target#" in x for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan))


@pytest.mark.parametrize("names", [1, 2])
@pytest.mark.parametrize("most", [3, 4_000_000])
def test_pairs_of_tests_and_supertypes_come_once(spark, monkeypatch, names, most):
    """Against brute force, with ids of one name and of several, and keys that are dealt to parts."""
    monkeypatch.setattr(R, "PAIRS", most, raising=False)
    symbols = [(f"m{k % (60 // names)}", f"Svc{k % 4}", "class", f"src/main/m{k % (60 // names)}.java") for k in range(60)]
    symbols += [(f"t{k % (40 // names)}", f"Svc{k % 3}Test", "class", f"src/test/t{k % (40 // names)}.java") for k in range(40)]
    calls = [(f"t{k % 23}", f"Svc{k % 5}") for k in range(80)] + [("m1", "Svc1"), ("gone", "Svc2")]
    supers = [(f"m{k % 7}", f"Svc{k % 3}") for k in range(30)]
    s = spark.createDataFrame(symbols, "id string, name string, kind string, path string")
    tests, targets = [x for x in symbols if x[0][0] == "t"], [x for x in symbols if x[0][0] == "m"]
    by_name = {(a[0], b[0]) for a in tests for b in targets if a[1] == f"{b[1]}Test"}
    ids = {a[0] for a in tests}
    by_call = {(a, b[0]) for a, callee in calls if a in ids for b in targets if b[1] == callee} - by_name
    found = R.test_edges(s, spark.createDataFrame(calls, "src string, callee string"))
    assert sorted((r.src, r.dst, r.confidence) for r in found.collect()) == sorted([(*x, 0.9) for x in by_name] + [(*x, 0.6) for x in by_call])
    above = R.supertype_edges(spark.createDataFrame(supers, "id string, super string"), s)
    assert sorted((r.src, r.dst) for r in above.collect()) == sorted({(a, x[0]) for a, name in supers for x in symbols if x[1] == name and x[0] != a})
    if names == 1:
        assert not _shuffles_pairs(found.select("src", "dst")) and not _shuffles_pairs(above)
