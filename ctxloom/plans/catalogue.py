"""The registered queries of the context graph over the driver's tables, each beside its SQL.

The tables stand in for a code base: parts are files, orders commits, customers authors, events API calls, documents sources. ``QUERIES`` maps a name to (query, SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.functions import text as X
from ctxloom.operators import drift as D
from ctxloom.operators import graph as G
from ctxloom.operators import history as H
from ctxloom.operators import resolve as R
from ctxloom.operators import search as S
from ctxloom.operators import store as W
from ctxloom.operators.impact import impact, impact_flat
from ctxloom.operators.rank import PackOptions, greedy_pack, related, score_columns, why_column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}
NOW = 1_706_745_600


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- search -------------------------------------------------------------------------------------------------------


def bm25_sql(table: str, id_col: str, weights: dict[str, float], terms: list[str], k: int) -> str:
    """BM25 in SQL: one list of terms a column, for one-word phrases."""
    tok = {c: f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')" for c in weights}
    dl = " + ".join(f"len({v})" for v in tok.values())
    fs = ", ".join("(" + " + ".join(f"{float(w)} * len(list_filter({tok[c]}, lambda x: x = '{q}'))" for c, w in weights.items()) + f") AS f{i}" for i, q in enumerate(terms))
    ns = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    part = lambda i: f"CASE WHEN f{i} > 0 THEN (CASE WHEN ln((nd - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((nd - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END"
    score = " + ".join(part(i) for i in range(len(terms)))
    any_hit = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"WITH d AS (SELECT {id_col} AS id, {dl} AS dl, {fs} FROM {table}), s AS (SELECT count(*) AS nd, avg(dl) AS avgdl, {ns} FROM d), r AS (SELECT id, {score} AS score FROM d, s WHERE {any_hit}) SELECT id, round(score, 6) AS score FROM (SELECT * FROM r ORDER BY round(score, 9) DESC, id LIMIT {k})"


def _search(spark, sf, table, id_col, weights, q, k):
    """The operator's own hits, with ties to nine places so that sums in another order rank alike."""
    found = S.bm25(t(spark, sf, table), id_col, weights, q, 10_000_000)
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(k).select("id", F.round("score", 6).alias("score"))


PARTS = {"p_name": 10.0, "p_type": 6.0, "p_brand": 3.0}


@query(bm25_sql("part", "p_partkey", PARTS, ["widget", "red", "promo", "brand", "13"], 20))
def q_search_parts(spark, sf):
    return _search(spark, sf, "part", "p_partkey", PARTS, "Widget red promo brand 13", 20)


@query(bm25_sql("documents", "doc_id", {"text": 1.0}, ["the", "idiot", "ement", "license"], 25))
def q_search_docs(spark, sf):
    return _search(spark, sf, "documents", "doc_id", {"text": 1.0}, "The idiot ement license", 25)


CAMEL_SQL = "concat('get', upper(left(e, 1)), substr(e, 2), 'V2Api_', e, '-', m)"
SPLIT_SQL = "list_filter(regexp_split_to_array(regexp_replace({0}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '[_\\-./ ]+'), lambda p: strlen(p) > 1)"


@query(f"WITH x AS (SELECT DISTINCT event_type AS e, user_id % 40 AS m FROM events) SELECT {CAMEL_SQL} AS name, array_to_string({SPLIT_SQL.format(CAMEL_SQL)}, ' ') AS words FROM x")
def q_identifier_split(spark, sf):
    e = F.col("event_type")
    name = F.concat(F.lit("get"), F.upper(F.left(e, F.lit(1))), F.substring(e, 2, 100), F.lit("V2Api_"), e, F.lit("-"), F.col("user_id") % 40)
    return t(spark, sf, "events").select(name.alias("name")).distinct().select("name", F.array_join(X.split_identifier("name"), " ").alias("words"))


@query(f"""WITH x AS (SELECT p_partkey, p_name AS name, concat('src/', p_type, '/', p_brand, '/', replace(p_name, ' ', '_'), '.py') AS path FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat({SPLIT_SQL.format('name')}, {SPLIT_SQL.format("array_to_string(string_split(path, '/')[-2:], '/')")}))), ' ') AS tokens FROM x""")
def q_index_tokens(spark, sf):
    path = F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_brand", F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".py"))
    return t(spark, sf, "part").select("p_partkey", X.index_tokens("p_name", path).alias("tokens"))


SYNONYMS = {"small": ["little", "tiny"], "red": ["scarlet"], "économie": ["economy"]}


@query(f"""WITH x AS (SELECT DISTINCT concat(p_name, ' ', lower(p_type), 'PartName') AS q FROM part), w AS (SELECT q, unnest(string_split(q, ' ')) AS w FROM x),
e AS (SELECT q, w AS v FROM w UNION SELECT q, unnest(CASE lower(w) WHEN 'small' THEN ['little', 'tiny'] WHEN 'red' THEN ['scarlet'] ELSE [] END) FROM w UNION SELECT q, unnest(CASE WHEN len({SPLIT_SQL.format('w')}) > 1 THEN {SPLIT_SQL.format('w')} ELSE [] END) FROM w)
SELECT q AS query, string_agg(DISTINCT v, ' ' ORDER BY v) AS expanded FROM e GROUP BY q""")
def q_query_expand(spark, sf):
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = t(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit("PartName")).alias("query")).distinct()
    return rows.select("query", X.expand_query("query", table).alias("expanded"))


# ---- routes and URLs ------------------------------------------------------------------------------------------------

ROUTE_SQL = r"""CASE WHEN s = '' THEN '/' ELSE s END"""
RAW_EVENTS = "SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN concat('/api/users/${{id}}/', event_type, '/') WHEN 1 THEN concat('\"api/users/{{id}}/', event_type, '\"') WHEN 2 THEN concat('/api/:user/', event_type) ELSE concat('/v', user_id, '/x${{q}}/', event_type) END AS raw FROM events".replace("{{", "{").replace("}}", "}")
NORM = r"regexp_replace(regexp_replace(regexp_replace({0}, '^[\"''`]+|[\"''`]+$', '', 'g'), '\$?\{{[^}}]*\}}?', '{{}}', 'g'), '/:[^/]*', '/{{}}', 'g')"


def _raw_events(spark, sf):
    u, e = F.col("user_id"), F.col("event_type")
    raw = F.when(u % 4 == 0, F.concat(F.lit("/api/users/${id}/"), e, F.lit("/"))).when(u % 4 == 1, F.concat(F.lit('"api/users/{id}/'), e, F.lit('"'))).when(u % 4 == 2, F.concat(F.lit("/api/:user/"), e)).otherwise(F.concat(F.lit("/v"), u, F.lit("/x${q}/"), e))
    return t(spark, sf, "events").select(raw.alias("raw")).distinct()


@query(f"WITH r AS ({RAW_EVENTS} UNION SELECT DISTINCT regexp_extract(url, '^https?://[^/]*(/[^?]*)', 1) FROM pages), n AS (SELECT raw, {NORM.format('raw')} AS s0 FROM r), l AS (SELECT raw, regexp_replace(CASE WHEN s0 LIKE '/%' THEN s0 ELSE '/' || s0 END, '/+$', '') AS s FROM n) SELECT raw, CASE WHEN s = '' THEN '/' ELSE s END AS path FROM l")
def q_route_normalize(spark, sf):
    pages = t(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://[^/]*(/[^?]*)", 1).alias("raw"))
    return _raw_events(spark, sf).unionByName(pages).distinct().select("raw", X.route_path("raw").alias("path"))


@query(rf"WITH r AS ({RAW_EVENTS}) SELECT raw, regexp_matches(regexp_replace(raw, '/\$\{{[^}}]*\}}(/|$)', '/\1', 'g'), '\$\{{') AS dynamic FROM r")
def q_dynamic_segment(spark, sf):
    return _raw_events(spark, sf).select("raw", X.has_dynamic_segment("raw").alias("dynamic"))


@query("""WITH k AS (SELECT concat('K', p_size % 20) AS name, concat('/', lower(p_type)) AS value FROM part WHERE p_size % 20 < 6 UNION SELECT concat('K', p_size % 20), concat('/size', p_size % 20) FROM part WHERE p_size % 20 >= 6),
c AS (SELECT name, any_value(value) AS value FROM k GROUP BY name HAVING count(DISTINCT value) = 1),
u AS (SELECT p_partkey AS id, concat('K', p_partkey % 25) AS n, p_partkey % 3 AS tail FROM part), f AS (SELECT id, tail, coalesce(value, '{}') AS head, value IS NULL AS unk FROM u LEFT JOIN c ON n = name)
SELECT id, concat(head, CASE tail WHEN 0 THEN '/list' WHEN 1 THEN '/{}' ELSE '/x{}' END) AS path, (unk OR tail = 2) AS dynamic FROM f""")
def q_url_fill_constants(spark, sf):
    part = t(spark, sf, "part")
    k = F.col("p_size") % 20
    constants = part.select(F.concat(F.lit("K"), k).alias("name"), F.when(k < 6, F.concat(F.lit("/"), F.lower("p_type"))).otherwise(F.concat(F.lit("/size"), k)).alias("value"))
    p = lambda tag, v: F.struct(F.lit(tag).alias("tag"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    tail = F.col("p_partkey") % 3
    parts = F.when(tail == 0, F.array(p("lit", "/list"))).when(tail == 1, F.array(p("lit", "/"), p("unk", ""))).otherwise(F.array(p("lit", "/x"), p("unk", "")))
    calls = part.select(F.col("p_partkey").alias("id"), F.concat(F.array(p("named", F.concat(F.lit("K"), F.col("p_partkey") % 25))), parts).alias("parts"))
    return R.fill_urls(calls, constants)


API_SQL = """WITH c AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'purchase' THEN 'POST' ELSE 'PUT' END AS method, concat('/api/users/{}/', event_type) AS path, user_id % 10 = 0 AS dynamic FROM events),
r(rid, m, p) AS (VALUES ('route:GET /api/users/{}/view', 'GET', '/api/users/{}/view'), ('route:ANY /api/users/{}/view', 'ANY', '/api/users/{}/view'), ('route:ANY /api/users/{}/click', 'ANY', '/api/users/{}/click'), ('route:GET /api/users/{}/purchase', 'GET', '/api/users/{}/purchase')),
h AS (SELECT id, method, path, rid, CASE WHEN m = method THEN 0.9 ELSE 0.6 END AS conf FROM c LEFT JOIN r ON p = path AND m IN (method, 'ANY') WHERE NOT dynamic)
SELECT id, method, path, arg_max(rid, conf) AS dst, max(CASE WHEN rid IS NULL THEN NULL ELSE conf END)::DOUBLE AS confidence FROM h GROUP BY id, method, path"""


def _api(spark, sf):
    e = t(spark, sf, "events")
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "purchase", "POST").otherwise("PUT")
    calls = e.select(F.col("event_id").alias("id"), method.alias("method"), F.concat(F.lit("/api/users/{}/"), "event_type").alias("path"), (F.col("user_id") % 10 == 0).alias("dynamic"))
    rows = [("GET", "view"), ("ANY", "view"), ("ANY", "click"), ("GET", "purchase")]
    routes = spark.createDataFrame([(f"route:{m} /api/users/{{}}/{p}", m, f"/api/users/{{}}/{p}") for m, p in rows], "id string, method string, path string")
    return calls, routes


@query(API_SQL)
def q_api_link(spark, sf):
    return R.link_api_calls(*_api(spark, sf))


# ---- calls, imports, types ------------------------------------------------------------------------------------------

SYMS = "SELECT concat('sym:', c_custkey) AS id, concat('f', CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 100 ELSE c_custkey % 700 + 200 END) AS name FROM customer"
CALLS = "SELECT concat('sym:', o_orderkey % 1500) AS src, concat('f', o_custkey % 1000) AS callee, o_orderkey FROM orders"
RESOLVED = f"WITH s AS ({SYMS}), c AS ({CALLS}), n AS (SELECT name, count(*) AS n FROM s GROUP BY name), r AS (SELECT c.*, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' WHEN n <= 3 THEN 'ambiguous' ELSE 'dropped' END AS outcome FROM c LEFT JOIN n ON name = callee)"


def _symbols(spark, sf):
    k = F.col("c_custkey")
    return t(spark, sf, "customer").select(F.concat(F.lit("sym:"), k).alias("id"), F.concat(F.lit("f"), F.when(k % 7 == 0, k % 100).otherwise(k % 700 + 200)).alias("name"))


def _resolved(spark, sf):
    calls = t(spark, sf, "orders").select(F.concat(F.lit("sym:"), F.col("o_orderkey") % 1500).alias("src"), F.concat(F.lit("f"), F.col("o_custkey") % 1000).alias("callee"))
    return R.resolve_calls(calls, _symbols(spark, sf))


@query(RESOLVED + " SELECT src, id AS dst, max(0.8 / n) AS confidence FROM r JOIN s ON name = callee WHERE n <= 3 AND src <> id GROUP BY src, id")
def q_resolve_calls(spark, sf):
    return R.call_edges(_resolved(spark, sf)).select("src", "dst", "confidence")


@query(RESOLVED + " SELECT count(*) AS total, count(*) FILTER (outcome = 'resolved') AS resolved, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'unresolved') AS unresolved, count(*) FILTER (outcome = 'dropped') AS dropped, round(count(*) FILTER (outcome IN ('resolved', 'ambiguous')) / count(*), 9) AS link_rate FROM r")
def q_resolve_stats(spark, sf):
    return R.resolve_stats(_resolved(spark, sf)).withColumn("link_rate", F.round("link_rate", 9))


@query(RESOLVED + " SELECT callee, count(*) AS n FROM r WHERE outcome IN ('unresolved', 'dropped') GROUP BY callee ORDER BY n DESC, callee LIMIT 8")
def q_top_unresolved(spark, sf):
    return R.top_unresolved(_resolved(spark, sf))


@query("""WITH s AS (SELECT concat('f', l_orderkey) AS file, concat('s', l_orderkey, '.', l_linenumber, '.', l_partkey) AS id, (l_linenumber * 10)::INT AS a, (l_linenumber * 10 + l_quantity)::INT AS b FROM lineitem),
c AS (SELECT concat('f', o_orderkey) AS file, o_orderkey AS call, (10 + o_orderkey % 60)::INT AS line FROM orders), h AS (SELECT call, c.file, line, id, row_number() OVER (PARTITION BY call ORDER BY b - a, a, id) AS r FROM c JOIN s ON c.file = s.file AND line BETWEEN a AND b)
SELECT c.call, c.line, coalesce(h.id, c.file) AS enclosing FROM c LEFT JOIN h ON c.call = h.call AND r = 1""")
def q_enclosing_symbol(spark, sf):
    li = t(spark, sf, "lineitem")
    start = (F.col("l_linenumber") * 10).cast("int")
    spans = li.select(F.concat(F.lit("f"), "l_orderkey").alias("file"), F.concat(F.lit("s"), "l_orderkey", F.lit("."), "l_linenumber", F.lit("."), "l_partkey").alias("id"), start.alias("start_line"), (start + F.col("l_quantity")).cast("int").alias("end_line"))
    calls = t(spark, sf, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("file"), F.col("o_orderkey").alias("call"), (10 + F.col("o_orderkey") % 60).cast("int").alias("line"))
    return R.enclosing_symbols(calls, spans).select("call", "line", "enclosing")


IMPORTS = """WITH f AS (SELECT concat('file:', p_partkey) AS id, CASE p_partkey % 2 WHEN 0 THEN concat('src/main/java/com/', replace(lower(p_brand), '#', ''), '/P', p_partkey % 300, '.java') ELSE concat('web/', replace(lower(p_brand), '#', ''), '/m', p_partkey % 300, CASE WHEN p_partkey % 3 = 0 THEN '/index.ts' ELSE '.tsx' END) END AS path FROM part),
k AS (SELECT lower(path) AS key, max(id) AS found FROM f GROUP BY 1),
i AS (SELECT concat('i', o_orderkey) AS file, concat('web/brand', o_orderkey % 25, '/x.ts') AS path, CASE o_orderkey % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'typescript' ELSE 'python' END AS lang, CASE o_orderkey % 3 WHEN 0 THEN concat('com.brand', o_custkey % 30, '.P', o_custkey % 400) WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN concat('../brand', o_custkey % 30, '/m', o_custkey % 400) ELSE concat('@scope/pkg', o_custkey % 5, '/deep') END ELSE concat('mod', o_custkey % 9, '.sub') END AS spec FROM orders),
c AS (SELECT *, CASE lang WHEN 'java' THEN [concat(replace(spec, '.', '/'), '.java'), concat('src/main/java/', replace(spec, '.', '/'), '.java')] WHEN 'typescript' THEN CASE WHEN spec LIKE '../%' THEN list_transform(['.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'], lambda e: concat('web/', spec[4:], e)) ELSE [] END ELSE [] END AS paths FROM i),
t AS (SELECT file, unnest(paths) AS p, generate_subscripts(paths, 1) AS o FROM c), b AS (SELECT file, arg_min(found, o) AS found FROM t JOIN k ON lower(p) = key GROUP BY file)
SELECT c.file, spec, CASE WHEN found IS NULL THEN 'depends_on' ELSE 'imports' END AS kind, coalesce(found, concat('dep:', CASE lang WHEN 'java' THEN array_to_string(string_split(spec, '.')[1:2], '.') WHEN 'typescript' THEN regexp_extract(spec, '^(@[^/]+/[^/]+|[^/]+)', 1) ELSE spec END)) AS dst FROM c LEFT JOIN b ON c.file = b.file"""


def _imports(spark, sf):
    p, brand = F.col("p_partkey"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    path = F.when(p % 2 == 0, F.concat(F.lit("src/main/java/com/"), brand, F.lit("/P"), p % 300, F.lit(".java"))).otherwise(F.concat(F.lit("web/"), brand, F.lit("/m"), p % 300, F.when(p % 3 == 0, "/index.ts").otherwise(".tsx")))
    files = t(spark, sf, "part").select(F.concat(F.lit("file:"), p).alias("id"), path.alias("path"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    spec = F.when(o % 3 == 0, F.concat(F.lit("com.brand"), c % 30, F.lit(".P"), c % 400)).when((o % 3 == 1) & (o % 2 == 0), F.concat(F.lit("../brand"), c % 30, F.lit("/m"), c % 400)).when(o % 3 == 1, F.concat(F.lit("@scope/pkg"), c % 5, F.lit("/deep"))).otherwise(F.concat(F.lit("mod"), c % 9, F.lit(".sub")))
    imports = t(spark, sf, "orders").select(F.concat(F.lit("i"), o).alias("file"), F.concat(F.lit("web/brand"), o % 25, F.lit("/x.ts")).alias("path"), F.when(o % 3 == 0, "java").when(o % 3 == 1, "typescript").otherwise("python").alias("lang"), spec.alias("spec"))
    return R.resolve_imports(imports, files)


@query(IMPORTS)
def q_import_resolve(spark, sf):
    return _imports(spark, sf)


@query(f"SELECT dst, count(*) AS n FROM ({IMPORTS}) WHERE kind = 'depends_on' GROUP BY dst")
def q_external_deps(spark, sf):
    return _imports(spark, sf).where("kind = 'depends_on'").groupBy("dst").agg(F.count("*").alias("n"))


TYPES = f"WITH s AS ({SYMS}), u AS (SELECT DISTINCT concat('f', s_suppkey + 200) AS sub, concat('f', s_suppkey % 20 + 300) AS super FROM supplier), "


def _types(spark, sf):
    k = F.col("s_suppkey")
    return t(spark, sf, "supplier").select(F.concat(F.lit("f"), k + 200).alias("sub"), F.concat(F.lit("f"), k % 20 + 300).alias("super")).distinct()


@query(TYPES + "x AS (SELECT a.id, super FROM s a JOIN u ON a.name = u.sub) SELECT DISTINCT x.id AS src, s.id AS dst, 0.85::DOUBLE AS confidence FROM x JOIN s ON s.name = x.super WHERE x.id <> s.id")
def q_supertypes(spark, sf):
    s = _symbols(spark, sf)
    subs = s.join(_types(spark, sf), F.col("name") == F.col("sub")).select("id", "super")
    return R.supertype_edges(subs, s).select("src", "dst", "confidence")


@query(TYPES + "w AS (SELECT DISTINCT concat('own', p_partkey % 50) AS owner, concat('f', p_size % 40 + 290) AS type FROM part), t AS (SELECT owner, type, id FROM w JOIN s ON name = type UNION SELECT owner, type, id FROM w JOIN u ON super = type JOIN s ON name = sub), n AS (SELECT *, count(*) OVER (PARTITION BY owner, type) AS n FROM t) SELECT owner AS src, id AS dst, max(0.9 / n) AS confidence FROM n GROUP BY owner, id")
def q_implementors_inject(spark, sf):
    wanted = t(spark, sf, "part").select(F.concat(F.lit("own"), F.col("p_partkey") % 50).alias("owner"), F.concat(F.lit("f"), F.col("p_size") % 40 + 290).alias("type"))
    return R.inject_edges(wanted, _symbols(spark, sf), _types(spark, sf)).select("src", "dst", "confidence")


TEST_SYMS = "WITH s AS (SELECT concat('p', p_partkey) AS id, CASE p_partkey % 5 WHEN 0 THEN concat('Svc', p_size, 'Test') WHEN 1 THEN concat('TestSvc', p_size) WHEN 2 THEN concat('Svc', p_size, 'Spec') ELSE concat('Svc', p_size) END AS name, CASE WHEN p_partkey % 5 < 3 THEN concat('src/test/x', p_partkey, '.java') ELSE concat('src/main/x', p_partkey, '.java') END AS path, CASE WHEN p_partkey % 11 = 0 THEN 'field' ELSE 'class' END AS kind FROM part), g AS (SELECT id AS target, name FROM s WHERE kind = 'class' AND path LIKE 'src/main/%'), "
BY_NAME = "n AS (SELECT DISTINCT s.id AS src, target AS dst FROM s JOIN g ON g.name = CASE WHEN s.name LIKE '%Test' THEN left(s.name, -4) WHEN s.name LIKE '%Spec' THEN left(s.name, -4) ELSE substr(s.name, 5) END WHERE path LIKE 'src/test/%')"
BY_CALL = ", k AS (SELECT DISTINCT concat('p', o_orderkey % 2000) AS src, concat('Svc', o_custkey % 50) AS callee FROM orders), c AS (SELECT DISTINCT k.src, target AS dst FROM k JOIN s ON s.id = k.src AND path LIKE 'src/test/%' JOIN g ON g.name = callee)"


def _tests(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(p % 5 == 0, F.concat(F.lit("Svc"), size, F.lit("Test"))).when(p % 5 == 1, F.concat(F.lit("TestSvc"), size)).when(p % 5 == 2, F.concat(F.lit("Svc"), size, F.lit("Spec"))).otherwise(F.concat(F.lit("Svc"), size))
    path = F.concat(F.when(p % 5 < 3, "src/test/x").otherwise("src/main/x"), p, F.lit(".java"))
    symbols = t(spark, sf, "part").select(F.concat(F.lit("p"), p).alias("id"), name.alias("name"), path.alias("path"), F.when(p % 11 == 0, "field").otherwise("class").alias("kind"))
    calls = t(spark, sf, "orders").select(F.concat(F.lit("p"), F.col("o_orderkey") % 2000).alias("src"), F.concat(F.lit("Svc"), F.col("o_custkey") % 50).alias("callee"))
    return R.test_edges(symbols, calls)


@query(TEST_SYMS + BY_NAME + " SELECT src, dst FROM n")
def q_tests_by_name(spark, sf):
    return _tests(spark, sf).where("confidence = 0.9").select("src", "dst")


@query(TEST_SYMS + BY_NAME + BY_CALL + " SELECT src, dst FROM c EXCEPT SELECT src, dst FROM n")
def q_tests_by_call(spark, sf):
    return _tests(spark, sf).where("confidence = 0.6").select("src", "dst")


# ---- SQL and persistence --------------------------------------------------------------------------------------------

STATEMENTS = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('SELECT a FROM dbo.orders', p_size, ' o JOIN items', p_size % 7, ' i ON o.x = i.x') WHEN 1 THEN concat('INSERT INTO log', p_size, ' VALUES (1)') WHEN 2 THEN concat('delete from cart', p_size, ' where fromage = 1') ELSE concat('UPDATE users', p_size, ' SET x = 1') END AS sql FROM part"
SCRAPE = "x AS ({}) ".format(" UNION ".join(f"SELECT id, unnest(regexp_extract_all(lower(sql), '(?:^|[^\\p{{L}}\\p{{N}}_]){w}\\s+([\\p{{L}}\\p{{N}}_.]+)', 1)) AS raw, '{v}' AS verb FROM s" for w, v in (("from", "select"), ("join", "select"), ("into", "insert"), ("update", "update"), ("delete\\s+from", "delete"))))
SCRAPED = f"WITH s AS ({STATEMENTS}), {SCRAPE} SELECT DISTINCT id, list_extract(string_split(raw, '.'), -1) AS table_name, verb FROM x"


def _scraped(spark, sf):
    p, size = F.col("p_partkey"), F.col("p_size")
    sql = F.when(p % 4 == 0, F.concat(F.lit("SELECT a FROM dbo.orders"), size, F.lit(" o JOIN items"), size % 7, F.lit(" i ON o.x = i.x"))).when(p % 4 == 1, F.concat(F.lit("INSERT INTO log"), size, F.lit(" VALUES (1)"))).when(p % 4 == 2, F.concat(F.lit("delete from cart"), size, F.lit(" where fromage = 1"))).otherwise(F.concat(F.lit("UPDATE users"), size, F.lit(" SET x = 1")))
    rows = t(spark, sf, "part").select(p.alias("id"), F.explode(X.tables_in_sql(sql)).alias("x"))
    return rows.select("id", F.col("x.table").alias("table_name"), F.col("x.verb").alias("verb")).distinct()


@query(SCRAPED)
def q_sql_tables(spark, sf):
    return _scraped(spark, sf)


@query(f"WITH e AS (SELECT concat('c', s_suppkey) AS src, concat('table:', lower(CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE concat('T_', s_nationkey) END)) AS dst, CASE WHEN s_suppkey % 3 = 0 THEN 0.6 ELSE 0.95 END AS confidence FROM supplier UNION ALL SELECT concat('m', id), concat('table:', lower(table_name)), CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.85 END FROM ({SCRAPED})) SELECT src, dst, max(confidence)::DOUBLE AS confidence FROM e GROUP BY src, dst")
def q_persist_tables(spark, sf):
    s = t(spark, sf, "supplier")
    entities = s.select(F.concat(F.lit("c"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("T_"), "s_nationkey")).alias("table"))
    found = _scraped(spark, sf).select(F.concat(F.lit("m"), "id").alias("id"), F.col("table_name").alias("table"), F.when(F.col("id") % 2 == 0, "xml").otherwise("annotation").alias("source"))
    return R.persist_edges(entities, found).select("src", "dst", "confidence")


# ---- history --------------------------------------------------------------------------------------------------------

PAIRS = "WITH c AS (SELECT DISTINCT l_partkey AS f, l_orderkey AS k FROM lineitem), z AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM c), p AS (SELECT a.f AS a, b.f AS b, count(*) AS n FROM z a JOIN z b ON a.k = b.k AND a.f < b.f WHERE a.n <= 7 GROUP BY 1, 2 HAVING count(*) >= 2)"


def _changes(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("commit"))


@query(PAIRS + " SELECT a, b, n, round(ln(1 + n), 6) AS weight FROM p")
def q_cochange_pairs(spark, sf):
    return H.cochange_pairs(_changes(spark, sf), most_files=7).withColumn("weight", F.round("weight", 6))


@query(PAIRS + ", e AS (SELECT a AS s, b AS d FROM p UNION ALL SELECT b, a FROM p), x AS (SELECT d AS id, 1.0 AS s FROM e WHERE s < 100), y AS (SELECT * FROM x UNION ALL SELECT id + 1000000, 0.5 FROM x), g AS (SELECT id, sum(s) AS s FROM y GROUP BY id) SELECT id::VARCHAR AS id, round(s / (SELECT max(s) FROM g), 6)::DOUBLE AS score FROM g")
def q_cochange_scores(spark, sf):
    pairs = H.cochange_pairs(_changes(spark, sf), most_files=7)
    co = H.cochange_edges(pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "weight"))
    part = t(spark, sf, "part")
    inside = part.select(F.col("p_partkey").cast("string").alias("f"), (F.col("p_partkey") + 1_000_000).cast("string").alias("s")).select(*R.edge("f", "s", "contains", 1.0))
    seeds = part.where("p_partkey < 100").select(F.col("p_partkey").cast("string").alias("id"))
    return H.cochange_scores(seeds, co.unionByName(inside)).withColumn("score", F.round("score", 6))


@query("SELECT concat(c_custkey % 50, '@x') AS email, arg_min(c_name, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS name, count(DISTINCT o_orderkey) AS commits FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def q_authors(spark, sf):
    c = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    commits = c.select(F.concat(F.col("c_custkey") % 50, F.lit("@x")).alias("email"), F.col("c_name").alias("author"), F.unix_timestamp("o_orderdate").alias("epoch"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("sha"))
    return H.authors(commits)


@query("SELECT DISTINCT concat('file:', l_partkey) AS src, concat('commit:', l_orderkey) AS dst FROM lineitem")
def q_modified_by(spark, sf):
    changes = t(spark, sf, "lineitem").select(F.concat(F.lit("file:"), "l_partkey").alias("file"), F.concat(F.lit("commit:"), "l_orderkey").alias("commit"))
    return H.modified_by(changes).select("src", "dst")


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def q_lookup_nodes(spark, sf):
    """Nodes by their ids; ids come with repeats."""
    nodes = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("kind"))
    return W.lookup(nodes, t(spark, sf, "orders").select(F.col("o_custkey").alias("id")), ["id", "name", "kind"])


# ---- store ----------------------------------------------------------------------------------------------------------


@query("WITH o AS (SELECT c_custkey AS id, lower(c_name) AS key, c_name AS name FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT o_custkey AS id, concat('k', o_orderkey) AS key, concat('n', o_orderkey) AS name, o_orderkey AS seq FROM orders), f AS (SELECT id, arg_max(name, seq) AS name, arg_min(key, seq) AS k FROM b GROUP BY id) SELECT id, coalesce(o.key, f.k) AS key, f.name FROM f LEFT JOIN o USING (id) UNION ALL SELECT id, key, name FROM o WHERE id NOT IN (SELECT id FROM f)")
def q_upsert_nodes(spark, sf):
    old = t(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("key"), F.col("c_name").alias("name"))
    batch = t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("k"), "o_orderkey").alias("key"), F.concat(F.lit("n"), "o_orderkey").alias("name"), F.col("o_orderkey").alias("seq"))
    return W.upsert_nodes(old, batch)


@query("WITH o AS (SELECT DISTINCT s_suppkey AS src, s_nationkey::BIGINT AS dst, 'in' AS kind, 1.0::DOUBLE AS weight FROM supplier), b AS (SELECT l_suppkey AS src, l_partkey % 25 AS dst, 'in' AS kind, arg_max(l_quantity, l_orderkey * 10 + l_linenumber + l_quantity / 100) AS weight FROM lineitem GROUP BY 1, 2) SELECT src, dst, kind, weight FROM b UNION ALL SELECT * FROM o WHERE (src, dst) NOT IN (SELECT (src, dst) FROM b)")
def q_upsert_edges(spark, sf):
    old = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.lit("in").alias("kind"), F.lit(1.0).alias("weight")).distinct()
    li = t(spark, sf, "lineitem")
    batch = li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 25).alias("dst"), F.lit("in").alias("kind"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_quantity") / 100).alias("seq"))
    return W.upsert_edges(old, batch)


def _files(spark, sf):
    nodes = t(spark, sf, "part").select(F.concat(F.lit("file:"), "p_partkey").alias("id"), F.lit("file").alias("kind"), F.col("p_brand").alias("repo"), F.concat(F.lit("Src/"), "p_partkey").alias("path"))
    edges = t(spark, sf, "lineitem").select(F.concat(F.lit("file:"), "l_partkey").alias("src"), F.concat(F.lit("file:"), (F.col("l_partkey") + F.col("l_suppkey")) % 2000).alias("dst")).distinct()
    return nodes, edges


GONE = "SELECT concat('file:', p_partkey) AS id FROM part WHERE p_brand = 'Brand#13' AND p_partkey % 3 > 0"


@query(f"SELECT 'node' AS what, count(*) AS n FROM part WHERE concat('file:', p_partkey) NOT IN ({GONE}) UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT concat('file:', l_partkey) AS a, concat('file:', (l_partkey + l_suppkey) % 2000) AS b FROM lineitem) WHERE a NOT IN ({GONE}) AND b NOT IN ({GONE})")
def q_prune_missing(spark, sf):
    nodes, edges = _files(spark, sf)
    seen = t(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("src/"), "p_partkey").alias("path"))
    n, e = W.prune_missing(nodes, edges, "Brand#13", seen)
    return n.agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "n").unionByName(e.agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "n"))


@query("WITH k AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 4 = 0)) SELECT 'commit' AS kind, count(DISTINCT o_orderkey) AS n FROM k UNION ALL SELECT 'author', count(DISTINCT o_custkey) FROM k")
def q_prune_orphans(spark, sf):
    o = t(spark, sf, "orders")
    nodes = o.select(F.concat(F.lit("commit:"), "o_orderkey").alias("id"), F.lit("commit").alias("kind")).unionByName(o.select(F.concat(F.lit("author:"), "o_custkey").alias("id"), F.lit("author").alias("kind")).distinct())
    touched = t(spark, sf, "lineitem").where("l_partkey % 4 = 0").select(F.concat(F.lit("file:"), "l_partkey").alias("src"), F.concat(F.lit("commit:"), "l_orderkey").alias("dst")).distinct()
    edges = touched.unionByName(o.select(F.concat(F.lit("commit:"), "o_orderkey").alias("src"), F.concat(F.lit("author:"), "o_custkey").alias("dst")))
    left, _ = W.prune_orphans(nodes, edges)
    return left.groupBy("kind").agg(F.count("*").alias("n"))


# ---- traversal ------------------------------------------------------------------------------------------------------

GRAPH = """n AS (SELECT concat('r', r_regionkey) AS id, 'table' AS kind, r_name AS name FROM region UNION ALL SELECT concat('n', n_nationkey), 'route', n_name FROM nation UNION ALL SELECT concat('s', s_suppkey), 'symbol', s_name FROM supplier UNION ALL SELECT concat('c', c_custkey), 'file', c_name FROM customer),
e AS (SELECT concat('r', n_regionkey) AS src, concat('n', n_nationkey) AS dst, 'contains' AS kind FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'calls_api' FROM supplier UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), 'handles' FROM customer UNION ALL SELECT concat('c', c_custkey), concat('s', c_custkey % 100), 'calls' FROM customer)"""


def _graph(spark, sf):
    at = lambda c, k: F.concat(F.lit(c), k)
    r, n, s, c = (t(spark, sf, x) for x in ("region", "nation", "supplier", "customer"))
    node = lambda df, a, key, kind, name: df.select(at(a, key).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"))
    nodes = node(r, "r", "r_regionkey", "table", "r_name").unionByName(node(n, "n", "n_nationkey", "route", "n_name")).unionByName(node(s, "s", "s_suppkey", "symbol", "s_name")).unionByName(node(c, "c", "c_custkey", "file", "c_name"))
    link = lambda df, a, x, b, y, kind: df.select(*R.edge(at(a, F.col(x)), at(b, y if not isinstance(y, str) else F.col(y)), kind, 1.0))
    edges = link(n, "r", "n_regionkey", "n", "n_nationkey", "contains").unionByName(link(s, "s", "s_suppkey", "n", "s_nationkey", "calls_api"))
    edges = edges.unionByName(link(c, "n", "c_nationkey", "c", "c_custkey", "handles")).unionByName(link(c, "c", "c_custkey", "s", F.col("c_custkey") % 100, "calls"))
    return nodes, edges


def bfs_sql(start: str, step: str, depth: int, kinds: str = "") -> str:
    where = f"WHERE kind IN ({kinds})" if kinds else ""
    steps = {"out": f"SELECT src AS a, dst AS b FROM e {where}", "in": f"SELECT dst AS a, src AS b FROM e {where}"}
    s = f"{steps['out']} UNION ALL {steps['in']}" if step == "both" else steps[step]
    return f"WITH RECURSIVE {GRAPH}, s AS ({s}), w(id, depth) AS (SELECT '{start}', 0 UNION SELECT b, depth + 1 FROM w JOIN s ON a = id WHERE depth < {depth}) SELECT id, min(depth)::INT AS depth FROM w WHERE id IN (SELECT id FROM n) GROUP BY id HAVING min(depth) > 0"


def _around(spark, sf, start, **how):
    nodes, edges = _graph(spark, sf)
    return G.neighbors(nodes, edges, spark.createDataFrame([(start,)], "id string"), **how)


@query(bfs_sql("n3", "both", 1))
def q_neighbors_d1(spark, sf):
    return _around(spark, sf, "n3")


@query(bfs_sql("s7", "both", 2))
def q_neighbors_d2(spark, sf):
    return _around(spark, sf, "s7", depth=2)


@query(bfs_sql("n3", "in", 2))
def q_neighbors_in(spark, sf):
    return _around(spark, sf, "n3", direction="in", depth=2)


@query(bfs_sql("c20", "out", 3, "'calls', 'calls_api'"))
def q_neighbors_kinds(spark, sf):
    return _around(spark, sf, "c20", kinds=("calls", "calls_api"), direction="out", depth=3)


@query(f"WITH {GRAPH} SELECT src AS id, dst FROM e WHERE kind = 'handles' AND src IN ('n1', 'n2', 'n3')")
def q_neighbors_of_kind(spark, sf):
    _, edges = _graph(spark, sf)
    return G.neighbors_of_kind(edges, spark.createDataFrame([("n1",), ("n2",), ("n3",)], "id string"), "handles")


@query(f"WITH RECURSIVE {GRAPH}, w(here, path, len) AS (SELECT 'r0', 'r0', 0 UNION SELECT dst, concat(path, '>', dst), len + 1 FROM w JOIN e ON src = here WHERE len < 3), h AS (SELECT path, len FROM w WHERE here IN (SELECT concat('s', min(c_custkey) % 100) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))) SELECT min(path) AS path, len::INT AS length FROM h WHERE len = (SELECT min(len) FROM h) GROUP BY len")
def q_shortest_path(spark, sf):
    nodes, edges = _graph(spark, sf)
    inside = t(spark, sf, "nation").where("n_regionkey = 0").select("n_nationkey")
    end = t(spark, sf, "customer").join(inside, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").agg(F.min("c_custkey") % 100).first()[0]
    return G.shortest_path(edges, "r0", f"s{end}").select(F.array_join("path", ">").alias("path"), F.col("length").cast("int").alias("length"))


@query(f"WITH {GRAPH}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id), x AS (SELECT n.id, coalesce(d.n, 0) AS degree FROM n LEFT JOIN d USING (id)) SELECT id, degree, round(degree / (SELECT greatest(max(degree), 1) FROM x), 9) AS centrality FROM x")
def q_degree_centrality(spark, sf):
    return G.degree_centrality(*_graph(spark, sf)).withColumn("centrality", F.round("centrality", 9))


PPR_SQL = f"""WITH RECURSIVE {GRAPH}, l AS (SELECT * FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)), b AS (SELECT src AS a, dst AS z FROM l UNION ALL SELECT dst, src FROM l), d AS (SELECT a, count(*) AS d FROM b GROUP BY a), m AS (SELECT b.a, z, count(*) / any_value(d)::DOUBLE AS w FROM b JOIN d USING (a) GROUP BY b.a, z),
r(k, id, x) AS (SELECT 0, id, CASE WHEN id IN ('n3', 's7') THEN 0.5 ELSE 0.0 END::DOUBLE FROM n UNION ALL SELECT any_value(k) + 1, id, sum(x) FROM (SELECT r.k, m.z AS id, 0.5 * r.x * m.w AS x FROM r JOIN m ON m.a = r.id WHERE r.k < 25 UNION ALL SELECT r.k, r.id, CASE WHEN r.id IN ('n3', 's7') THEN 0.25 ELSE 0.0 END FROM r WHERE r.k < 25) GROUP BY id)
SELECT id, round(x, 7) AS rank FROM r WHERE k = 25"""


@query(PPR_SQL)
def q_ppr(spark, sf):
    return G.personalized_pagerank(*_graph(spark, sf), ["n3", "s7"]).withColumn("rank", F.round("rank", 7))


@query(PPR_SQL)
def q_ppr_joins(spark, sf):
    return G.personalized_pagerank(*_graph(spark, sf), ["n3", "s7"], kernel_edges=0).withColumn("rank", F.round("rank", 7))


@query(f"WITH RECURSIVE {GRAPH}, i AS (SELECT dst AS a, src AS b FROM e WHERE kind IN ('calls', 'injects')), h AS (SELECT src AS a, dst AS b FROM e WHERE kind IN ('handles', 'calls_api') UNION ALL SELECT dst, src FROM e WHERE kind IN ('handles', 'calls_api')), x(id, depth) AS (SELECT 's7', 0 UNION SELECT b, depth + 1 FROM x JOIN i ON a = id WHERE depth < 2), y(id, depth) AS (SELECT 's7', 0 UNION SELECT b, depth + 1 FROM y JOIN h ON a = id WHERE depth < 2), p AS (SELECT id, min(depth)::INT AS depth FROM x GROUP BY id HAVING min(depth) > 0), q AS (SELECT id, min(depth)::INT AS depth FROM y GROUP BY id HAVING min(depth) > 0) SELECT * FROM (SELECT id, 'caller' AS role, depth FROM p ORDER BY depth, id LIMIT 40) UNION ALL SELECT * FROM (SELECT id, 'cross' AS role, depth FROM q ORDER BY depth, id LIMIT 20)")
def q_impact(spark, sf):
    return impact(*_graph(spark, sf), spark.createDataFrame([("s7",)], "id string"))


@query(bfs_sql("s7", "both", 2, "'calls', 'injects', 'calls_api', 'handles'"))
def q_impact_flat(spark, sf):
    return impact_flat(*_graph(spark, sf), spark.createDataFrame([("s7",)], "id string"))


@query(f"WITH {GRAPH}, h AS (SELECT src AS a, dst AS b, upper(kind) AS via FROM e WHERE kind IN ('handles', 'calls_api')), f AS (SELECT b AS id, via FROM h WHERE a IN ('s7', 's8')), g AS (SELECT * FROM f UNION SELECT h.b, h.via FROM f JOIN h ON h.a = f.id WHERE h.via = 'HANDLES') SELECT DISTINCT g.id, via, left(g.id, 1) AS repo FROM g JOIN n ON n.id = g.id WHERE n.kind = 'route' OR left(g.id, 1) NOT IN ('s') ORDER BY 1, 2 LIMIT 8")
def q_related_cross_repo(spark, sf):
    nodes, edges = _graph(spark, sf)
    return related(nodes.withColumn("repo", F.left("id", F.lit(1))), edges, spark.createDataFrame([("s7",), ("s8",)], "id string"), ["s"])


# ---- ranking and packing --------------------------------------------------------------------------------------------

TERMS = "SELECT concat('p', p_partkey) AS id, CASE p_partkey % 4 WHEN 0 THEN 'symbol' WHEN 1 THEN 'file' WHEN 2 THEN 'route' ELSE 'api_call' END AS kind, (p_partkey % 97) / 97.0 AS bm25, (p_partkey % 89) / 89.0 AS ppr, p_size / 50.0 AS centrality, (p_partkey % 7) / 7.0 AS cochange, pow(0.5, (p_partkey % 400) / 30.0) AS recency, p_partkey FROM part"
PRIOR = "CASE kind WHEN 'symbol' THEN 1.0 WHEN 'route' THEN 0.85 WHEN 'api_call' THEN 0.7 WHEN 'file' THEN 0.3 ELSE 0.2 END"
SCORED = f"SELECT *, (0.7 * bm25 + 0.5 * ppr + 0.2 * centrality + 0.4 * cochange + 0.3 * recency) * {PRIOR} AS score FROM ({TERMS})"


def _terms(spark, sf):
    p = F.col("p_partkey")
    kind = F.when(p % 4 == 0, "symbol").when(p % 4 == 1, "file").when(p % 4 == 2, "route").otherwise("api_call")
    rows = t(spark, sf, "part").select(F.concat(F.lit("p"), p).alias("id"), kind.alias("kind"), ((p % 97) / 97.0).alias("bm25"), ((p % 89) / 89.0).alias("ppr"), (F.col("p_size") / 50.0).alias("centrality"), ((p % 7) / 7.0).alias("cochange"), F.pow(F.lit(0.5), (p % 400) / 30.0).alias("recency"), "p_partkey")
    return rows.withColumn("score", score_columns()).withColumn("why", why_column())


@query(f"SELECT id, round(score, 6) AS score FROM ({SCORED}) ORDER BY round(score, 9) DESC, id LIMIT 120")
def q_rank_scores(spark, sf):
    return _terms(spark, sf).orderBy(F.desc(F.round("score", 9)), "id").limit(120).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(0.5 * ppr, 2) AS why_ppr, {PRIOR}::DOUBLE AS why_prior, CASE WHEN round(0.4 * cochange, 2) > 0 THEN round(0.4 * cochange, 2) END::DOUBLE AS why_cochange FROM ({TERMS})")
def q_rank_why(spark, sf):
    w = F.col("why")
    return _terms(spark, sf).select("id", F.try_element_at(w, F.lit("ppr")).alias("why_ppr"), F.try_element_at(w, F.lit("prior")).alias("why_prior"), F.try_element_at(w, F.lit("cochange")).alias("why_cochange"))


def _packed(spark, sf):
    rows = _terms(spark, sf).orderBy(F.desc(F.round("score", 9)), "id").limit(120)
    got = [r.asDict() | {"name": r["id"], "repo": f"b{r['p_partkey'] % 25}", "path": f"f{r['p_partkey'] % 60}", "ref": f"f{r['p_partkey'] % 60}:{r['p_partkey']}", "lines": [f"line {k} of {r['id']}" for k in range(r["p_partkey"] % 90)]} for r in rows.collect()]
    return greedy_pack(got, PackOptions())


@query()
def q_pack(spark, sf):
    items, _, _ = _packed(spark, sf)
    rows = [(k, i["id"], i["kind"], i["tier"], i["tokens"]) for k, i in enumerate(items)]
    return spark.createDataFrame(rows, "place int, id string, kind string, tier string, tokens int")


@query()
def q_pack_summary(spark, sf):
    items, stale, used = _packed(spark, sf)
    return spark.createDataFrame([(len(items), len(stale), used, used <= 4000)], "items int, stale int, tokens int, within boolean")


@query(f"SELECT event_id, round(pow(0.5, greatest({NOW} - epoch(date_trunc('second', ts))::BIGINT, 0) / 86400.0 / 30.0), 9) AS score FROM events")
def q_recency(spark, sf):
    return t(spark, sf, "events").select("event_id", F.round(X.recency(F.unix_timestamp("ts"), NOW), 9).alias("score"))


# ---- reports --------------------------------------------------------------------------------------------------------


@query("SELECT coalesce(lang, '(unknown)') AS lang, count(*) AS n FROM documents GROUP BY 1")
def q_files_by_language(spark, sf):
    return D.files_by_language(t(spark, sf, "documents").select(F.lit("file").alias("kind"), "lang"))


@query("SELECT lang, count(*) AS files, count(*) FILTER (NOT e) AS parsed, CASE WHEN count(*) FILTER (NOT e) / count(*) >= 0.99 THEN 'good' WHEN count(*) FILTER (NOT e) / count(*) >= 0.9 THEN 'fair' ELSE 'poor' END AS mark FROM (SELECT lang, doc_id % 15 = 0 AND lang <> 'en' AS e FROM documents) GROUP BY lang")
def q_lang_coverage(spark, sf):
    return D.language_coverage(t(spark, sf, "documents").select("lang", ((F.col("doc_id") % 15 == 0) & (F.col("lang") != "en")).alias("had_parse_error")))


@query(f"SELECT count(*) AS calls, count(dst) AS linked, round(100.0 * count(dst) / count(*), 4) AS percent, CASE WHEN count(dst) / count(*) >= 0.7 THEN 'good' WHEN count(dst) / count(*) >= 0.4 THEN 'fair' ELSE 'poor' END AS mark FROM ({API_SQL})")
def q_doctor(spark, sf):
    rows = R.link_api_calls(*_api(spark, sf)).agg(F.count("*").alias("calls"), F.count("dst").alias("linked"))
    share = F.col("linked") / F.col("calls")
    return rows.select("calls", "linked", F.round(100 * share, 4).alias("percent"), F.when(share >= 0.7, "good").when(share >= 0.4, "fair").otherwise("poor").alias("mark"))


def _snapshots(spark, sf):
    d = t(spark, sf, "documents")
    i = F.col("doc_id")
    old = d.where(i % 10 != 0).select(F.lit("r").alias("repo"), i.cast("string").alias("path"), F.md5("text").alias("content_hash"), (i * 60).alias("mtime"), F.when(i % 6 != 1, F.col("n_chars")).alias("bytes"))
    changed = i % 7 == 0
    new = d.where(i % 9 != 0).select(F.lit("r").alias("repo"), i.cast("string").alias("path"), F.when(changed, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("content_hash"), (i * 60 + (i % 5 == 0).cast("int")).alias("mtime"), (F.col("n_chars") + changed.cast("int")).alias("bytes"))
    return old, new


DRIFT = "WITH o AS (SELECT doc_id::VARCHAR AS path, md5(text) AS h, doc_id * 60 AS m, CASE WHEN doc_id % 6 <> 1 THEN n_chars END AS b FROM documents WHERE doc_id % 10 <> 0), p AS (SELECT doc_id::VARCHAR AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h, doc_id * 60 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS m, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS b FROM documents WHERE doc_id % 9 <> 0), s AS (SELECT coalesce(o.path, p.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN p.path IS NULL THEN 'removed' WHEN (o.m = p.m AND (o.b IS NULL OR o.b = p.b)) OR o.h = p.h THEN NULL ELSE 'changed' END AS state FROM o FULL JOIN p ON o.path = p.path)"


@query(DRIFT + " SELECT path, state FROM s WHERE state IS NOT NULL")
def q_drift_rows(spark, sf):
    return D.drift_rows(*_snapshots(spark, sf)).select("path", "state")


@query(DRIFT + " SELECT count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'removed') AS removed, (SELECT count(*) FROM o) AS indexed FROM s")
def q_drift(spark, sf):
    return D.drift(*_snapshots(spark, sf))


@query("WITH c AS (SELECT DISTINCT md5(text) AS h, lang FROM documents WHERE doc_id % 3 = 0), d AS (SELECT md5(text) AS h, lang FROM documents) SELECT count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE c.h = d.h AND c.lang = d.lang)) AS hits, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.h = d.h AND c.lang = d.lang)) AS misses FROM d")
def q_cache_hits(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("content_hash"))
    cache = d.where("doc_id % 3 = 0").select("content_hash", "lang").distinct().withColumn("payload", F.lit("{}")).withColumn("used_at", F.lit(0))
    hits, misses, _ = D.cache_lookup(d, cache, 1)
    return hits.agg(F.count("*").alias("hits")).crossJoin(misses.agg(F.count("*").alias("misses")))  # one row each


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 100, md5(doc_id::VARCHAR)) AS r, count(*) OVER () AS n FROM documents) WHERE r > n // 4")
def q_cache_evict(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("content_hash"), F.lit("x").alias("lang"), (F.col("doc_id") % 100).alias("used_at"), F.col("n_chars").alias("bytes"))
    return D.cache_evict(rows, 1000).select("doc_id")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch(date_trunc('second', min(ts)))::BIGINT AS first_at, count(*) AS n FROM s GROUP BY user_id, k")
def q_debounce_events(spark, sf):
    from ctxloom.streaming.watch import debounced

    return debounced(t(spark, sf, "events"), "ts", ["user_id"], "1 hour").select("user_id", F.unix_timestamp("started").alias("first_at"), "n")


@query("WITH r AS (SELECT o_orderkey AS task, o_custkey % 900 + 100 AS packed, o_custkey AS plain, o_orderkey % 4 AS e FROM orders) SELECT floor(avg(packed))::BIGINT AS packed, floor(avg(plain))::BIGINT AS plain, round(avg(CASE WHEN plain > 0 THEN 1 - packed / plain ELSE 0 END), 6) AS saving, round(avg(CASE WHEN e > 0 THEN (CASE e WHEN 1 THEN 1 ELSE 1 END) / e END), 6) AS recall FROM r")
def q_bench_recall(spark, sf):
    o = t(spark, sf, "orders")
    names = F.array(F.lit("a.py"), F.lit("b.py"), F.lit("c.py"))
    rows = o.select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 900 + 100).alias("packed"), F.col("o_custkey").alias("plain"), F.slice(names, F.lit(1), (F.col("o_orderkey") % 4).cast("int")).alias("expected"), F.array(F.lit("src/a.py:1-9"), F.lit("src/x.py")).alias("refs"))
    return D.bench_summary(rows).withColumn("saving", F.round("saving", 6)).withColumn("recall", F.round("recall", 6))


PATHS = "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('src/test/A', doc_id, '.java') WHEN 1 THEN concat('web/x', doc_id, '.test.tsx') WHEN 2 THEN concat('py/test_', doc_id, '.py') WHEN 3 THEN concat('src/main/B', doc_id, '.JAVA') WHEN 4 THEN concat('a/b', doc_id, '.rs') WHEN 5 THEN concat('docs/c', doc_id, '.unknown') WHEN 6 THEN concat('svc/D', doc_id, 'Tests.cs') ELSE concat('lib/e', doc_id, '.jsx') END AS path FROM documents"


def _paths(spark, sf):
    i = F.col("doc_id")
    parts = [("src/test/A", ".java"), ("web/x", ".test.tsx"), ("py/test_", ".py"), ("src/main/B", ".JAVA"), ("a/b", ".rs"), ("docs/c", ".unknown"), ("svc/D", "Tests.cs"), ("lib/e", ".jsx")]
    p = F.coalesce(*(F.when(i % 8 == k, F.concat(F.lit(a), i, F.lit(b))) for k, (a, b) in enumerate(parts)))
    return t(spark, sf, "documents").select("doc_id", p.alias("path"))


@query(f"SELECT doc_id, path, (path LIKE 'src/test/%' OR path LIKE '%.test.tsx' OR path LIKE 'py/test\\_%' ESCAPE '\\' OR path LIKE '%Tests.cs') AS is_test FROM ({PATHS})")
def q_test_paths(spark, sf):
    return _paths(spark, sf).select("doc_id", "path", X.is_test_path("path").alias("is_test"))


@query(f"SELECT path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'java' THEN 'java' WHEN 'tsx' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'cs' THEN 'csharp' WHEN 'jsx' THEN 'javascript' END AS lang FROM ({PATHS})")
def q_lang_detect(spark, sf):
    return _paths(spark, sf).select("path", X.language("path").alias("lang"))


@query("SELECT doc_id, ceil(length(text) / 3.6)::BIGINT AS tokens, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS lines FROM documents")
def q_token_estimate(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.estimate_tokens("text").cast("long").alias("tokens"), X.line_count("text").alias("lines"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN concat('f', l_partkey) WHEN l_quantity::INT > l_linenumber THEN concat('f', l_partkey, ':', l_linenumber, '-', l_quantity::INT) ELSE concat('f', l_partkey, ':', l_linenumber) END AS ref FROM lineitem")
def q_reference(spark, sf):
    p = F.col("l_partkey")
    path, start = F.when(p % 5 != 0, F.concat(F.lit("f"), p)), F.when(p % 5 != 1, F.col("l_linenumber"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.reference(path, start, F.col("l_quantity").cast("int")).alias("ref"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS body, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 39) || '…' END AS short FROM documents")
def q_slice_lines(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.slice_lines("text", F.lit(2), F.lit(9), 3).alias("body"), X.truncate("text", 40).alias("short"))


@query("SELECT concat('repo:', p_brand) AS src, concat('file:', p_brand, '/', p_partkey) AS dst, 'contains' AS kind FROM part UNION SELECT concat('file:', p_brand, '/', p_partkey), concat('sym:', p_brand, '/', p_partkey, '#', p_name), 'contains' FROM part UNION SELECT concat('sym:', p_brand, '/', p_partkey, '#', p_name), concat('file:', p_brand, '/', p_partkey), 'defined_in' FROM part")
def q_structural_edges(spark, sf):
    p = t(spark, sf, "part")
    files = p.select(F.col("p_brand").alias("repo"), X.node_id("file", "p_brand", "p_partkey").alias("id"))
    symbols = p.select(X.node_id("file", "p_brand", "p_partkey").alias("file"), X.node_id("sym", "p_brand", "p_partkey", "p_name").alias("id"))
    return R.structural_edges(files, symbols, symbols.limit(0)).select("src", "dst", "kind")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
