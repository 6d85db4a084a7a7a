"""Registered queries of the sources: extraction, framework facts and scans over files that are made from the driver's tables, one file a row.

A template gives each row a source text, @ standing for the row's key and § for an at sign; the SQL beside a query states the facts of the template for every key.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.api import _mapper_rows
from ctxloom.functions import text as X
from ctxloom.operators import resolve as R
from ctxloom.plans.catalogue import query, t
from ctxloom.sources.extract import extract_files
from ctxloom.sources.framework import has_framework_facts

JAVA = """package shop.p@;
import java.util.List;
import static shop.Base.of;
/** Part @. */
§RestController
§RequestMapping("/api/v@/")
public class Part@ extends Base<X> implements One, Two {
  private static final String STOCK = "/api/stock@";
  §Autowired private Store@ store;
  public Part@(Mail mail) { this.mail = mail; }
  §GetMapping("/items/{id}")
  public List<Item@> find@(int id) throws E { return store.load(id, new Item@()); }
  §PostMapping public Item@ add(Item@ item) {
    rest.postForObject(STOCK + "/" + item, item, U.class);
    return item;
  }
}
§Entity §Table(name = "parts_@") class Item@ {}
interface Reads@ { §Select("select * from dbo.parts_@ p join sizes s") List<P> all(); }
"""
TYPESCRIPT = """import { api } from './api@';
export const use@ = async (id: string): Promise<X> => {
  return await fetch(`/api/v@/items/${id}`, { method: 'PUT' });
};
interface Props@ extends Base { a: string }
export class View@ extends Panel implements Props@ {
  run(x: number): void { this.go@(x) }
}
function top@() { use@('1'); }
"""
PYTHON = """from shop.base import thing
import json
# Loads order @.
def load@(x):
    return json.dumps(thing(x))
class Order@(Base, m.Other):
    __tablename__ = "orders_@"
    def run(self):
        load@(1)
§router.post("/orders@/{id}")
async def put@(id):
    requests.get(f"/api/v@/items/{id}")
"""
CSHARP = """using System.Text;
// Form @.
[ApiController]
[Route("api/f@")]
public partial class Form@ : Base, IThing {
  public Form@(Store@ store) {}
  public int Size { get; set; }
  [HttpGet("{id}")]
  public X Load(int id) { return http.GetFromJsonAsync<X>($"/api/q@/{id}"); }
}
class Plain@ { void Click() { Save(new Doc@()); } }
"""
RUST = """use std::fmt;
/// Point @.
pub struct P@ { x: i32 }
impl fmt::Display for P@ { fn fmt(&self) -> R { write@(self.x) } }
pub(crate) fn make@<'a>(x: &'a str) -> P@ { P@::new(x) }
trait T@ {}
"""
MAPPER = """<mapper namespace="shop.M@">
<select id="one@">select 1 from t@ <if test="a">join sizes</if></select>
<insert id="two">
  <selectKey>select 2</selectKey>insert into w@
</insert>
</mapper>"""
#: Language to the table and key that its files come from, and its template.
FILES = {
    "java": ("part", "p_partkey", JAVA),
    "typescript": ("supplier", "s_suppkey", TYPESCRIPT),
    "python": ("customer", "c_custkey", PYTHON),
    "csharp": ("supplier", "s_suppkey", CSHARP),
    "rust": ("supplier", "s_suppkey", RUST),
}


def _text(template: str, key: str) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("@"), F.col(key).cast("string")), F.lit("§"), F.lit("@"))


def _facts(spark: SparkSession, sf: str, *want: str, langs: Collection[str] = tuple(FILES)) -> DataFrame:
    """The facts of the kinds in ``want`` of all files in ``langs``; path is the row's key.

    Keys are dealt to all cores before the texts are made: a small table of many rows is read by few tasks.
    """
    files, text = None, None
    for lang in langs:
        table, key, template = FILES[lang]
        rows = t(spark, sf, table).select(F.lit(lang).alias("repo"), F.col(key).cast("string").alias("path"), F.lit(lang).alias("lang"))
        files = rows if files is None else files.unionByName(rows)
        text = (F if text is None else text).when(F.col("lang") == lang, _text(template, "path"))
    dealt = files.repartition(3 * spark.sparkContext.defaultParallelism)
    return extract_files(dealt.withColumn("text", text), want=want or None)


def expected(columns: str, rows: dict[str, list[tuple]]) -> str:
    """SQL for the rows that each language's file has, @ standing for its key."""

    def value(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool | int):
            return str(v)
        return "replace(replace('" + v.replace("'", "''") + "', '@', k), '§', '@')"

    parts = []
    for lang, of in rows.items():
        table, key, _ = FILES[lang]
        parts += [f"SELECT '{lang}' AS lang, k AS path, {', '.join(f'{value(v)} AS {c}' for v, c in zip(row, columns.split(), strict=True))} FROM (SELECT {key}::VARCHAR AS k FROM {table})" for row in of]
    return " UNION ALL ".join(parts)


SYMBOLS = {
    "java": [("Part@", "class", 5, 17), ("STOCK", "field", 8, 8), ("store", "field", 9, 9), ("Part@", "constructor", 10, 10), ("find@", "method", 11, 12), ("add", "method", 13, 16), ("Item@", "class", 18, 18), ("Reads@", "interface", 19, 19), ("all", "method", 19, 19)],
    "typescript": [("use@", "function", 2, 4), ("Props@", "interface", 5, 5), ("View@", "class", 6, 8), ("run", "method", 7, 7), ("top@", "function", 9, 9)],
    "python": [("load@", "function", 4, 5), ("Order@", "class", 6, 9), ("run", "function", 8, 9), ("put@", "function", 11, 12)],
    "csharp": [("Form@", "class", 3, 10), ("Form@", "constructor", 6, 6), ("Size", "property", 7, 7), ("Load", "method", 8, 9), ("Plain@", "class", 11, 11), ("Click", "method", 11, 11)],
    "rust": [("P@", "struct", 3, 3), ("fmt", "function", 4, 4), ("make@", "function", 5, 5), ("T@", "trait", 6, 6)],
}


@query(expected("name kind start_line end_line", SYMBOLS))
def q_extract_symbols(spark, sf):
    return _facts(spark, sf, "symbols").select("lang", "path", F.inline("symbols")).select("lang", "path", "name", "kind", "start_line", "end_line")


SIGNATURES = {
    "java": [("Part@", "§RestController", "/** Part @. */"), ("Item@", '§Entity §Table(name = "parts_@") class Item@ {}', None)],
    "typescript": [("Props@", "interface Props@ extends Base { a: string }", None), ("top@", "function top@() { use@('1'); }", None)],
    "python": [("load@", "def load@(x):", "# Loads order @."), ("Order@", "class Order@(Base, m.Other):", None), ("put@", "async def put@(id):", None)],
    "csharp": [("Form@", "[ApiController]", "// Form @."), ("Plain@", "class Plain@ { void Click() { Save(new Doc@()); } }", None)],
    "rust": [("P@", "pub struct P@ { x: i32 }", "/// Point @."), ("T@", "trait T@ {}", None)],
}


@query(expected("name signature doc", SIGNATURES))
def q_extract_signatures(spark, sf):
    """First lines and comments of the types, and of functions outside them."""
    rows = _facts(spark, sf, "symbols").select("lang", "path", F.inline("symbols")).where(F.col("kind").isin("class", "struct", "trait") | (F.col("lang").isin("typescript", "python") & F.rlike("signature", F.lit("^(interface|function|def|async) ?.*[0-9]"))))
    return rows.where("not (lang = 'typescript' and kind = 'class')").select("lang", "path", "name", "signature", "doc")


IMPORTS = {"java": ["java.util.List", "shop.Base.of"], "typescript": ["./api@"], "python": ["shop.base", "json"], "csharp": ["System.Text"], "rust": ["std::fmt"]}


@query(expected("spec", {lang: [(x,) for x in of] for lang, of in IMPORTS.items()}))
def q_extract_imports(spark, sf):
    return _facts(spark, sf, "imports").select("lang", "path", F.explode("imports").alias("spec"))


CALLS = {
    "java": [("load", 12), ("Item@", 12), ("postForObject", 14)],
    "typescript": [("fetch", 3), ("go@", 7), ("use@", 9)],
    "python": [("dumps", 5), ("thing", 5), ("load@", 9), ("post", 10), ("get", 12)],
    "csharp": [("GetFromJsonAsync", 9), ("Save", 11), ("Doc@", 11)],
    "rust": [("write@", 4), ("new", 5)],
}


@query(expected("callee line", CALLS))
def q_extract_calls(spark, sf):
    return _facts(spark, sf, "calls").select("lang", "path", F.inline("calls"))


SUPERTYPES = {
    "java": [("Part@", "Base"), ("Part@", "One"), ("Part@", "Two")],
    "typescript": [("Props@", "Base"), ("View@", "Panel"), ("View@", "Props@")],
    "python": [("Order@", "Base"), ("Order@", "Other")],
    "csharp": [("Form@", "Base"), ("Form@", "IThing")],
    "rust": [("P@", "Display")],
}


@query(expected("sub super", SUPERTYPES))
def q_extract_supertypes(spark, sf):
    return _facts(spark, sf, "supertypes").select("lang", "path", F.inline("supertypes"))


@query(expected("name partial", {"csharp": [("Form@", True), ("Plain@", False)]}))
def q_extract_partial(spark, sf):
    return _facts(spark, sf, "symbols", langs=["csharp"]).select("lang", "path", F.inline("symbols")).where("kind = 'class'").select("lang", "path", "name", "partial")


def _web(spark: SparkSession, sf: str, kind: str, schema: str) -> DataFrame:
    """One kind of the framework facts, a row each."""
    facts = F.from_json("framework", F.lit(f"struct<{kind}:array<struct<{schema}>>>"))
    langs = [lang for lang in FILES if has_framework_facts(lang, want=[kind])]
    return _facts(spark, sf, kind, langs=langs).select("lang", "path", F.inline(facts[kind]))


ROUTES = {"java": [("GET", "/api/v@/items/{}", "find@"), ("POST", "/api/v@", "add")], "python": [("POST", "/orders@/{}", "put@")], "csharp": [("GET", "/api/f@/{}", "Load")]}


@query(expected("method route handler", ROUTES))
def q_framework_routes(spark, sf):
    return _web(spark, sf, "routes", "method:string,path:string,handler:string").toDF("lang", "path", "method", "route", "handler")


@query(expected("bean stereotype", {"java": [("Part@", "RestController")], "csharp": [("Form@", "ApiController")]}))
def q_framework_beans(spark, sf):
    return _web(spark, sf, "beans", "bean:string,stereotype:string")


@query(expected("owner type", {"java": [("Part@", "Store@"), ("Part@", "Mail")]}))
def q_framework_injections(spark, sf):
    """Annotated fields and constructor parameters of Java beans."""
    return _web(spark, sf, "injects", "owner:string,type:string")


@query(expected("entity name", {"java": [("Item@", "parts_@")], "python": [("Order@", "orders_@")]}))
def q_framework_entities(spark, sf):
    return _web(spark, sf, "entities", "entity:string,table:string").toDF("lang", "path", "entity", "name")


@query(expected("owner name verb", {"java": [("Reads@", "parts_@", "select"), ("Reads@", "sizes", "select")]}))
def q_framework_annotation_sql(spark, sf):
    return _web(spark, sf, "table_refs", "owner:string,table:string,verb:string").toDF("lang", "path", "owner", "name", "verb")


API_CALLS = {"java": [("POST", "/api/stock@/{}", False, 14)], "typescript": [("PUT", "/api/v@/items/{}", False, 3)], "python": [("GET", "/api/v@/items/{}", False, 12)], "csharp": [("GET", "/api/q@/{}", False, 9)]}


@query(expected("method url dynamic line", API_CALLS))
def q_framework_api_calls(spark, sf):
    return _web(spark, sf, "api_calls", "method:string,path:string,dynamic:boolean,line:int").toDF("lang", "path", "method", "url", "dynamic", "line")


@query(expected("name value", {"java": [("STOCK", "/api/stock@"), ("Part@.STOCK", "/api/stock@")]}))
def q_framework_constants(spark, sf):
    """String constants by their names and by those with their types."""
    found = F.from_json("framework", F.lit("struct<string_constants:map<string,string>>"))["string_constants"]
    return _facts(spark, sf, "string_constants", langs=["java"]).select("lang", "path", F.explode(found).alias("name", "value"))


@query("WITH s AS (SELECT o_custkey::VARCHAR AS k FROM orders GROUP BY o_custkey) SELECT k AS path, concat('one', k) AS name, concat('shop.M', k) AS namespace, 2 AS start_line, 2 AS end_line, concat('t', k, ',sizes') AS tables FROM s UNION ALL SELECT k, 'two', concat('shop.M', k), 3, 5, concat('w', k) FROM s")
def q_mapper_statements(spark, sf):
    files = t(spark, sf, "orders").select("o_custkey").distinct().select(F.lit("r").alias("repo"), F.col("o_custkey").cast("string").alias("path"), _text(MAPPER, "o_custkey").alias("text"))
    return _mapper_rows(files).select("path", "name", "namespace", "start_line", "end_line", F.array_join("tables", ",").alias("tables"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def q_content_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"))


PLACE = "concat('\\\\?\\C:\\Work\\', p_brand, '\\src\\F', p_partkey, '.Java')"


@query(f"SELECT p_partkey, replace(substr({PLACE}, 5), chr(92), '/') AS normal, CASE WHEN p_brand <> 'Brand#13' THEN NULL ELSE concat('src/F', p_partkey, '.Java') END AS below, lower(replace(substr({PLACE}, 5), chr(92), '/')) AS key, concat('F', p_partkey, '.Java') AS repo FROM part")
def q_path_forms(spark, sf):
    """Normal form, path below a root, comparison key and last name of paths with the extended-length mark."""
    raw = F.concat(F.lit("\\\\?\\C:\\Work\\"), "p_brand", F.lit("\\src\\F"), "p_partkey", F.lit(".Java"))
    normal = X.normalize_path(raw)
    return t(spark, sf, "part").select("p_partkey", normal.alias("normal"), X.relative_to(normal, F.lit("C:/Work/Brand#13/")).alias("below"), X.compare_key(normal).alias("key"), X.repo_name(raw).alias("repo"))


@query("SELECT DISTINCT concat('route:GET /', k) AS src, concat('sym:', k) AS dst, 'handles' AS kind FROM (SELECT l_partkey AS k FROM lineitem WHERE l_partkey % 3 <> 0)")
def q_route_handlers(spark, sf):
    k = F.col("l_partkey")
    routes = t(spark, sf, "lineitem").select(F.concat(F.lit("route:GET /"), k).alias("id"), F.when(k % 3 != 0, F.concat(F.lit("sym:"), k)).alias("handler"))
    return R.handle_edges(routes).select("src", "dst", "kind")
