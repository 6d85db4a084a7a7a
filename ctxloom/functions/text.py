"""Scalar functions of the context graph, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension to language; files with other extensions are not indexed (fixed values of the data model).
LANGUAGES = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "cs": "csharp", "py": "python", "pyi": "python",
    "md": "markdown", "markdown": "markdown", "sql": "sql", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml", "xml": "xml", "html": "html", "htm": "html", "css": "css", "scss": "css",
}
CODE = ("java", "kotlin", "typescript", "javascript", "rust", "csharp", "python")
PARSED = ("java", "typescript", "javascript", "rust", "python", "csharp")
#: Places and names by which a file counts as a test, over its lower-cased path.
TEST_PATH = r"(^|/)(test|tests|__tests__|spec|specs)/|\.test\.[jt]sx?$|\.spec\.[jt]sx?$|_test\.(py|go|rs)$|test\.java$|tests\.java$|tests?\.cs$"
#: Characters for one token in the estimate.
CHARS_PER_TOKEN = 3.6


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_path(p: Column | str) -> Column:
    """Forward slashes, without the extended-length mark."""
    return F.regexp_replace(F.regexp_replace(_c(p), r"^\\\\\?\\", ""), r"\\", "/")


def relative_to(p: Column | str, root: Column | str) -> Column:
    """The path below ``root``; null outside it."""
    p, root = _c(p), F.rtrim(_c(root), F.lit("/"))
    return F.when(F.startswith(p, F.concat(root, F.lit("/"))), F.substring(p, F.length(root) + 2, F.length(p)))


def compare_key(p: Column | str) -> Column:
    return F.lower(_c(p))


def repo_name(p: Column | str) -> Column:
    last = F.element_at(F.split(F.rtrim(normalize_path(p), F.lit("/")), "/"), -1)
    return F.when(F.length(last) > 0, last).otherwise(F.lit("repo"))


def language(p: Column | str) -> Column:
    """Language by extension, null if none is known."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(_c(p), r"\.([^./]+)$", 1)))


def line_count(s: Column | str) -> Column:
    return F.length(_c(s)) - F.length(F.replace(_c(s), F.lit("\n"), F.lit(""))) + 1


def content_hash(b: Column | str) -> Column:
    return F.sha2(_c(b), 256)


def split_identifier(s: Column | str) -> Column:
    """Words of a name: cut at _ - . / and blanks and before a capital after a small letter or digit; one-byte words are left out."""
    return F.filter(F.split(_c(s), r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|[_\-./ ]+"), lambda p: F.octet_length(p) > 1)


def index_tokens(name: Column | str, path: Column | str) -> Column:
    """Words of a name and of the last two parts of its path, sorted, each once."""
    parts = F.split(F.coalesce(_c(path), F.lit("")), "/")
    tail = F.array_join(F.when(F.size(parts) >= 2, F.slice(parts, -2, 2)).otherwise(parts), "/")
    return F.array_join(F.array_sort(F.array_distinct(F.concat(split_identifier(name), split_identifier(tail)))), " ")


def expand_query(query: Column | str, synonyms: Column | str) -> Column:
    """Each word, its synonyms (a map of lower-cased word to words) and, of names of several words, these; sorted, each once."""
    words = F.filter(F.split(_c(query), r"\s+"), lambda w: F.length(w) > 0)
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(_c(synonyms), F.lower(w)), F.array().cast("array<string>"))))
    camel = F.flatten(F.transform(words, lambda w: F.when(F.size(split_identifier(w)) > 1, split_identifier(w)).otherwise(F.array().cast("array<string>"))))
    return F.array_join(F.array_sort(F.array_distinct(F.concat(words, more, camel))), " ")


def reference(path: Column | str, start: Column | str, end: Column | str) -> Column:
    """How a place is shown: path:start-end, path:start, path, or null without a path."""
    path, start, end = _c(path), _c(start), _c(end)
    return F.when(path.isNull(), F.lit(None)).when(start.isNull(), path).when(end > start, F.concat(path, F.lit(":"), start, F.lit("-"), end)).otherwise(F.concat(path, F.lit(":"), start))


def external_dep(spec: Column | str, lang: Column | str) -> Column:
    """The package an import comes from: two dotted parts (java), package or @scope/package (ts, js), else all of it."""
    spec, lang = _c(spec), _c(lang)
    return F.when(lang == "java", F.substring_index(spec, ".", 2)).when(lang.isin("typescript", "javascript"), F.regexp_extract(spec, r"^(@[^/]+/[^/]+|[^/]+)", 1)).otherwise(spec)


def is_test_path(p: Column | str) -> Column:
    return F.lower(_c(p)).rlike(TEST_PATH) | F.element_at(F.split(_c(p), "/"), -1).rlike(r"^test_.*\.py$")


def test_subject(name: Column | str) -> Column:
    """The name under test: one ending Tests, Test or Spec, else a leading Test, taken off; null if fewer than 3 bytes are left."""
    name = _c(name)
    base = F.when(name.rlike("Tests$"), F.regexp_replace(name, "Tests$", "")).when(name.rlike("Test$"), F.regexp_replace(name, "Test$", "")).when(name.rlike("Spec$"), F.regexp_replace(name, "Spec$", "")).when(name.rlike("^Test"), F.regexp_replace(name, "^Test", ""))
    return F.when(F.octet_length(base) >= 3, base)


def java_import_paths(spec: Column | str) -> Column:
    """Files that a Java import may mean, best first; none for a wildcard."""
    file = F.concat(F.replace(_c(spec), F.lit("."), F.lit("/")), F.lit(".java"))
    return F.when(_c(spec).endswith("*"), F.array().cast("array<string>")).otherwise(F.array(file, F.concat(F.lit("src/main/java/"), file)))


def fold_relative(base: Column | str, spec: Column | str) -> Column:
    """``spec`` seen from the directory of file ``base``, with . and .. resolved; null above the root."""
    parts = F.concat(F.split(F.coalesce(F.regexp_extract(_c(base), r"^(.*)/[^/]*$", 1), F.lit("")), "/"), F.split(_c(spec), "/"))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(s: Column, p: Column) -> Column:
        up = F.when(F.size(s["at"]) > 0, F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(s["at"])
        at = F.when(p.isin("", "."), s["at"]).when(p == "..", up).otherwise(F.concat(s["at"], F.array(p)))
        return F.struct(at.alias("at"), (s["ok"] & ~((p == "..") & (F.size(s["at"]) == 0))).alias("ok"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["ok"], F.array_join(s["at"], "/")))


def ts_import_paths(base: Column | str, spec: Column | str) -> Column:
    """Files that a relative TypeScript or JavaScript import may mean, best first; none for a package."""
    at = fold_relative(base, spec)
    ends = [f".{e}" for e in ("ts", "tsx", "js", "jsx")] + [f"/index.{e}" for e in ("ts", "tsx", "js", "jsx")]
    return F.when(_c(spec).startswith(".") & at.isNotNull(), F.array(*(F.concat(at, F.lit(e)) for e in ends))).otherwise(F.array().cast("array<string>"))


def estimate_tokens(s: Column | str) -> Column:
    return F.ceil(F.char_length(_c(s)) / F.lit(CHARS_PER_TOKEN))


def recency(mtime: Column | str, now: Column | int) -> Column:
    """Half as much for every 30 days of age; 0 without a time, at most 1."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(now - _c(mtime), F.lit(0)) / 86400.0 / 30.0), F.lit(0.0))


def kind_prior(kind: Column | str) -> Column:
    kind = _c(kind)
    return F.when(kind == "symbol", 1.0).when(kind == "route", 0.85).when(kind == "api_call", 0.7).when(kind == "file", 0.3).otherwise(0.2)


def slice_lines(text: Column | str, start: Column | str, end: Column | str, cap: int) -> Column:
    """Lines start to end (from 1), at most ``cap`` of them."""
    start, end = _c(start), _c(end)
    return F.array_join(F.slice(F.split(_c(text), "\n"), start, F.greatest(F.least(end - start + 1, F.lit(cap)), F.lit(0))), "\n")


def truncate(s: Column | str, n: int) -> Column:
    s = _c(s)
    return F.when(F.char_length(s) <= n, s).otherwise(F.concat(F.left(s, F.lit(n - 1)), F.lit("…")))


def node_id(kind: str, *parts: Column | str) -> Column:
    """Ids by kind: repo:R, file:R/P, sym:R/P#N, route:M P, api:R/P#L:I, table:T, dep:N, commit:R/S, author:E."""
    p = [_c(x).cast("string") for x in parts]
    joins = {"repo": [""], "file": ["", "/"], "sym": ["", "/", "#"], "partial": ["", "#"], "route": ["", " "], "api": ["", "/", "#", ":"], "table": [""], "dep": [""], "commit": ["", "/"], "author": [""]}[kind]
    out: list[Column] = [F.lit({"partial": "sym"}.get(kind, kind) + ":")]
    for j, x in zip(joins, p, strict=True):
        out += [F.lit(j), F.lower(x) if kind == "table" else x]
    return F.concat(*out)


def route_path(p: Column | str) -> Column:
    """A route's path in one form: parameters as {}, one leading slash, none at the end."""
    s = F.regexp_replace(_c(p), "^[\"'`]+|[\"'`]+$", "")
    s = F.regexp_replace(s, r"\$?\{[^}]*\}?", "{}")
    s = F.regexp_replace(s, r"(?<=/):[^/]*", "{}")
    s = F.when(F.startswith(s, F.lit("/")), s).otherwise(F.concat(F.lit("/"), s))
    s = F.regexp_replace(s, "/+$", "")
    return F.when(F.length(s) == 0, F.lit("/")).otherwise(s)


def has_dynamic_segment(p: Column | str) -> Column:
    """Whether a ${...} fills less than a whole segment."""
    whole = F.regexp_replace(_c(p), r"(?<=/)\$\{[^}]*\}(?=/|$)", "")
    return whole.rlike(r"\$\{")


#: Words that are not tables though they may follow a keyword (fixed values).
SQL_WORDS = ("select", "where", "set", "values", "on", "as", "and")
SQL_VERBS = (("from", "select"), ("join", "select"), ("into", "insert"), ("update", "update"), ("delete from", "delete"))


def tables_in_sql(sql: Column | str) -> Column:
    """Array of (table, verb) that SQL text mentions, each once, in the order of keywords. ``DELETE FROM t`` also counts as a read of t."""
    s = F.lower(_c(sql))
    found = []
    for word, verb in SQL_VERBS:
        names = F.regexp_extract_all(s, F.lit(r"(?<![\p{L}\p{N}_])" + word.replace(" ", r"\s+") + r"\s+([\p{L}\p{N}_.]+)"), F.lit(1))
        names = F.transform(names, lambda t: F.substring_index(F.rtrim(t, F.lit(".")), ".", -1))
        names = F.filter(names, lambda t: (F.octet_length(t) >= 2) & ~t.rlike("^[0-9]") & ~t.isin(*SQL_WORDS))
        found.append(_with_verb(names, verb))
    return F.array_distinct(F.concat(*found))


def _with_verb(names: Column, verb: str) -> Column:
    return F.transform(names, lambda t: F.struct(t.alias("table"), F.lit(verb).alias("verb")))


# URL templates: ARRAY<STRUCT<tag, value>> with tag lit, unk or named.


def template_meaningful(parts: Column | str) -> Column:
    return F.exists(_c(parts), lambda p: p["tag"] != "unk")


def template_unresolved(parts: Column | str) -> Column:
    return F.exists(_c(parts), lambda p: p["tag"] == "named")


def template_dynamic(parts: Column | str) -> Column:
    """Whether an unknown part is not a whole segment: a literal ending in / before it, and after it one that starts with / or the end."""
    parts = _c(parts)

    def loose(p: Column, i: Column) -> Column:
        before, after = F.get(parts, i - 1), F.get(parts, i + 1)
        left = F.coalesce((before["tag"] == "lit") & F.endswith(before["value"], F.lit("/")), F.lit(False))
        right = after.isNull() | F.coalesce((after["tag"] == "lit") & F.startswith(after["value"], F.lit("/")), F.lit(False))
        return (p["tag"] == "unk") & ~(left & right)

    return F.exists(F.transform(parts, loose), lambda x: x)


def template_fill(parts: Column | str, constants: Column) -> Column:
    """Named parts become the literal a map of constants gives, or unknown."""

    def fill(p: Column) -> Column:
        value = F.try_element_at(constants, p["value"])
        known = (p["tag"] == "named") & value.isNotNull() & (F.length(value) > 0)
        tag = F.when(known, F.lit("lit")).when(p["tag"] == "named", F.lit("unk")).otherwise(p["tag"])
        return F.struct(tag.alias("tag"), F.when(known, value).when(p["tag"] == "named", F.lit("")).otherwise(p["value"]).alias("value"))

    return F.transform(_c(parts), fill)


def template_render(parts: Column | str) -> Column:
    return F.array_join(F.transform(_c(parts), lambda p: F.when(p["tag"] == "lit", p["value"]).otherwise(F.lit("{}"))), "")


def template_describe(parts: Column | str) -> Column:
    return F.array_join(F.transform(_c(parts), lambda p: F.when(p["tag"] == "lit", p["value"]).when(p["tag"] == "named", F.concat(F.lit("<"), p["value"], F.lit(">"))).otherwise(F.lit("{}"))), "")


def acceptable_call(path: Column | str, resolved: Column) -> Column:
    """Whether a call's rendered URL counts as an API call: once resolved it starts with / or has /api."""
    return ~resolved | F.startswith(_c(path), F.lit("/")) | F.contains(_c(path), F.lit("/api"))
