"""Link resolution: facts of files become typed edges, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import text as X

MAX_CANDIDATES = 3
#: Pairs of one key that a task makes; keys with more are dealt to several tasks.
PAIRS = 4_000_000
CALLABLE = ("method", "function", "constructor", "class", "record")


def edge(src: Column | str, dst: Column | str, kind: str, confidence: Column | float, provenance: str = "fast", weight: float = 1.0) -> list[Column]:
    c = F.lit(float(confidence)) if isinstance(confidence, int | float) else confidence
    return [X._c(src).alias("src"), X._c(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit(provenance).alias("provenance"), c.alias("confidence"), F.lit(weight).alias("weight")]


def enclosing_symbols(calls: DataFrame, spans: DataFrame) -> DataFrame:
    """``calls`` (file, line, ...) with ``enclosing``: the id of the narrowest of ``spans`` (file, id, start_line, end_line) that holds the line, else the file.

    A range join under an equality on the file; the first span wins a tie.
    """
    keyed = calls.withColumn("__call", F.monotonically_increasing_id())
    s = spans.select(F.col("file").alias("__file"), F.col("id").alias("__id"), "start_line", "end_line")
    hit = keyed.select("__call", "file", "line").join(s, (F.col("file") == F.col("__file")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = hit.groupBy("__call").agg(F.min_by("__id", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "__id")).alias("__best"))
    return keyed.join(best, "__call", "left").withColumn("enclosing", F.coalesce("__best", "file")).drop("__call", "__best")


def resolve_calls(calls: DataFrame, symbols: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """Every call (src, callee) with its candidates among ``symbols`` (id, name): src, callee, outcome, candidates, dst, confidence.

    Candidates are rows, duplicates counted: none is unresolved, one gets 0.8, up to ``most`` share it, more are dropped. One aggregate per name keeps at
    most ``most`` ids for a name, so names that thousands of symbols bear cost no more than others.
    """
    sizes = symbols.groupBy("name").agg(F.count("*").alias("n"))
    few = symbols.select("id", "name").join(sizes.where(F.col("n") <= most), "name").groupBy("name").agg(F.collect_list("id").alias("ids"))
    table = sizes.join(few, "name", "left")
    out = calls.join(table.withColumnRenamed("name", "callee"), "callee", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    outcome = F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").when(F.col("n") <= most, "ambiguous").otherwise("dropped")
    out = out.withColumn("outcome", outcome)
    return out.select("src", "callee", "outcome", F.col("n").alias("candidates"), F.explode_outer("ids").alias("dst"), F.when(F.col("n").between(1, most), F.lit(0.8) / F.col("n")).alias("confidence"))


def call_edges(resolved: DataFrame) -> DataFrame:
    """Edges of resolved calls; a symbol's calls of itself are left out after candidates were counted. The last of equal edges wins."""
    hit = resolved.where("dst is not null and src <> dst")
    return hit.groupBy("src", "dst").agg(F.max("confidence").alias("c")).select(*edge("src", "dst", "calls", F.col("c")))


def resolve_stats(resolved: DataFrame) -> DataFrame:
    """total, resolved, ambiguous, unresolved, dropped calls and the link rate."""
    one = resolved.groupBy("src", "callee", "outcome").agg(F.count("*").alias("rows"), F.first("candidates").alias("candidates"))
    calls = one.select("outcome", F.when(F.col("outcome").isin("resolved", "ambiguous"), F.col("rows") / F.col("candidates")).otherwise(F.col("rows")).cast("long").alias("calls"))
    count = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("calls"))), F.lit(0)).alias(o)
    t = calls.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("total"), *(count(o) for o in ("resolved", "ambiguous", "unresolved", "dropped")))
    return t.withColumn("link_rate", F.when(F.col("total") > 0, (F.col("resolved") + F.col("ambiguous")) / F.col("total")).otherwise(F.lit(0.0)))


def top_unresolved(resolved: DataFrame, n: int = 8) -> DataFrame:
    """The names that most calls could not be linked by (none or too many candidates), by count and name."""
    return resolved.where(F.col("outcome").isin("unresolved", "dropped")).groupBy("callee").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee").limit(n)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (file, path, lang, spec) with the file that the first of its candidate paths names among ``files`` (id, path), or the package.

    Returns file, spec, kind (imports or depends_on) and dst. Paths compare in lower case and without the repository; the last id wins.
    """
    paths = F.when(F.col("lang") == "java", X.java_import_paths("spec")).when(F.col("lang").isin("typescript", "javascript"), X.ts_import_paths("path", "spec")).otherwise(F.array().cast("array<string>"))
    rows = imports.select("file", "spec", "lang", paths.alias("paths"))
    table = files.groupBy(F.lower("path").alias("key")).agg(F.max("id").alias("found"))
    tried = rows.select("file", "spec", F.posexplode("paths").alias("k", "try")).withColumn("key", F.lower("try")).join(table, "key")
    best = tried.groupBy("file", "spec").agg(F.min_by("found", "k").alias("found"))
    out = rows.drop("paths").join(best, ["file", "spec"], "left")
    return out.select("file", "spec", F.when(F.col("found").isNotNull(), "imports").otherwise("depends_on").alias("kind"), F.coalesce("found", F.concat(F.lit("dep:"), X.external_dep("spec", "lang"))).alias("dst"))


def merge_constants(constants: DataFrame) -> DataFrame:
    """(name, value) of string constants (name, value) over all files; a name with two values is unknown and left out."""
    return constants.groupBy("name").agg(F.count_distinct("value").alias("n"), F.first("value").alias("value")).where("n = 1").select("name", "value")


def fill_urls(calls: DataFrame, constants: DataFrame) -> DataFrame:
    """``calls`` (id, parts) with named parts replaced by ``constants`` (name, value): id, path, dynamic.

    The names a call uses are joined, not the whole table shipped. A filled path must start with / or contain /api, else it counts as dynamic.
    """
    names = calls.select("id", F.explode(F.filter("parts", lambda p: p["tag"] == "named")).alias("p")).select("id", F.col("p.value").alias("name")).distinct()
    known = names.join(merge_constants(constants), "name").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("known"))
    rows = calls.join(known, "id", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    rows = rows.withColumn("filled", X.template_fill("parts", F.col("known")))
    path = X.template_render("filled")
    fits = F.startswith(path, F.lit("/")) | F.contains(path, F.lit("/api"))
    return rows.select("id", path.alias("path"), (X.template_dynamic("filled") | ~fits).alias("dynamic"))


def link_api_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``calls`` (id, method, path, dynamic) with the route of the same method and path (0.9), else of method ANY (0.6): id, dst, confidence; dst null if none."""
    r = routes.select(F.col("method").alias("r_method"), F.col("path").alias("r_path"), F.col("id").alias("dst")).distinct()
    live = calls.where("not dynamic")
    hit = live.join(r, (F.col("path") == F.col("r_path")) & ((F.col("r_method") == F.col("method")) | (F.col("r_method") == "ANY")))
    best = hit.groupBy("id").agg(F.max_by("dst", F.when(F.col("r_method") == F.col("method"), 2).otherwise(1)).alias("dst"), F.max(F.when(F.col("r_method") == F.col("method"), 0.9).otherwise(0.6)).alias("confidence"))
    return live.select("id", "method", "path").join(best, "id", "left")


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, dst) for every pair of rows of ``left`` (src, key) and ``right`` (dst, key) with the same key.

    The pairs of a key can be as many as the product of its rows, so its left rows are dealt to parts and its right rows copied to each.
    """
    count = lambda df, n: df.groupBy("key").agg(F.count("*").alias(n))
    parts = count(left, "n").join(count(right, "m"), "key").select("key", F.ceil(F.col("n") * F.col("m") / F.lit(PAIRS)).alias("parts"))
    a = left.join(parts, "key").select("src", "key", F.pmod(F.xxhash64("src"), "parts").alias("part"))
    b = right.join(parts, "key").select("dst", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["key", "part"]).select("src", "dst")


def _by_names(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows of ``named`` (dst, key): those of ids with one key, which give no pair twice, and those of ids with several."""
    span = named.where("key is not null").groupBy("dst").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    several = span.where("key <> last").select(F.col("dst").alias("of"))
    return span.where("key = last").select("dst", "key"), named.join(several, F.col("dst").eqNullSafe(F.col("of")), "left_semi").distinct()


def supertype_edges(supertypes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``supertypes`` (id of the subtype, super) to every symbol of that name, 0.85.

    Pairs are only sorted out where a symbol's id has several names; others come once.
    """
    subs = supertypes.select(F.col("id").alias("src"), F.col("super").alias("key")).distinct()
    one, several = _by_names(symbols.select(F.col("id").alias("dst"), F.col("name").alias("key")))
    return _pairs(subs, one).unionByName(_pairs(subs, several).distinct()).where("src <> dst").select(*edge("src", "dst", "extends_implements", 0.85))


def inject_edges(injects: DataFrame, symbols: DataFrame, supertypes: DataFrame) -> DataFrame:
    """``injects`` (owner, type) to the symbols of that type and of its subtypes (``supertypes``: sub, super, by name), sharing 0.9."""
    named = symbols.select(F.col("name").alias("n"), F.col("id").alias("target"))
    wanted = injects.select("owner", "type").distinct()
    direct = wanted.join(named, F.col("type") == F.col("n")).select("owner", "type", "target")
    below = wanted.join(supertypes.select(F.col("super").alias("type"), F.col("sub").alias("n")).distinct(), "type").join(named, "n").select("owner", "type", "target")
    every = direct.unionByName(below).distinct()
    every = every.withColumn("n", F.count("*").over(Window.partitionBy("owner", "type"))).where("owner <> target")
    return every.groupBy("owner", "target").agg(F.max(F.lit(0.9) / F.col("n")).alias("c")).select(*edge("owner", "target", "injects", F.col("c")))


def test_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges from symbols in test files to what they test: by name (0.9), else by a call (0.6).

    ``symbols``: id, name, kind, path; ``calls``: src (an enclosing symbol's id) and callee. A call of what the test is named after is left out before
    pairs are made; pairs are only compared where a target's id has several names.
    """
    targets = symbols.where(F.col("kind").isin(*CALLABLE)).where(~X.is_test_path("path")).select(F.col("id").alias("dst"), F.col("name").alias("key"))
    one, several = _by_names(targets)
    tests = symbols.where(X.is_test_path("path")).select(F.col("id").alias("src"), X.test_subject("name").alias("key"))
    named = tests.where("key is not null").distinct()
    called = calls.select("src", F.col("callee").alias("key")).join(tests.select("src"), "src", "left_semi").distinct()
    by_name = _pairs(named, one).unionByName(_pairs(named, several).distinct())
    by_call = _pairs(called.join(named, ["src", "key"], "left_anti"), one).unionByName(_pairs(called, several).distinct().join(_pairs(named, several), ["src", "dst"], "left_anti"))
    return by_name.select(*edge("src", "dst", "tests", 0.9)).unionByName(by_call.select(*edge("src", "dst", "tests", 0.6)))


def handle_edges(routes: DataFrame) -> DataFrame:
    """``routes`` (id, handler) to their handlers."""
    return routes.where("handler is not null").select(*edge("id", "handler", "handles", 0.9)).distinct()


def persist_edges(entities: DataFrame, statements: DataFrame) -> DataFrame:
    """``entities`` (id, name, table: null if inferred) and ``statements`` (id, table, source annotation or xml) to tables, with ids in lower case."""
    of = entities.select(*edge("id", X.node_id("table", F.coalesce("table", "name")), "persists_to", F.when(F.col("table").isNull(), 0.6).otherwise(0.95)))
    sql = statements.select(*edge("id", X.node_id("table", "table"), "persists_to", F.when(F.col("source") == "xml", 0.9).otherwise(0.85)))
    return of.unionByName(sql).groupBy("src", "dst", "kind", "provenance", "weight").agg(F.max("confidence").alias("confidence")).select("src", "dst", "kind", "provenance", "confidence", "weight")


def structural_edges(files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """contains edges repository to file, file to symbol, file to API call; defined_in edges back from symbols."""
    a = files.select(*edge(X.node_id("repo", "repo"), "id", "contains", 1.0))
    b = symbols.select(*edge("file", "id", "contains", 1.0)).unionByName(symbols.select(*edge("id", "file", "defined_in", 1.0)))
    return a.unionByName(b).unionByName(calls.select(*edge("file", "id", "contains", 1.0))).distinct()
