"""Extraction from small sources of every language."""

import pytest

from ctxloom.sources.extract import extract
from ctxloom.sources.framework import framework_facts, mapper_statements
from ctxloom.sources.rules import BUILTIN, merged, rules_toml


def names(facts, kind=None):
    return [s["name"] for s in facts["symbols"] if kind in (None, s["kind"])]


def test_python():
    f = extract("python", "a.py", "from os.path import join\nimport json\n# says hello\ndef hello(x):\n    return join(x, json.dumps(x))\nclass A(Base, m.Other):\n    def run(self):\n        hello(1)\n")
    assert names(f) == ["hello", "A", "run"] and f["imports"] == ["os.path", "json"]
    assert {c["callee"] for c in f["calls"]} == {"join", "dumps", "hello"}
    assert f["symbols"][0]["doc"] == "# says hello" and f["symbols"][0]["end_line"] == 5
    assert [(s["sub"], s["super"]) for s in f["supertypes"]] == [("A", "Base"), ("A", "Other")]
    assert extract("python", "a.py", "def broken(:\n  x(\n")["had_parse_error"]


def test_java():
    f = extract("java", "A.java", "package p;\nimport java.util.List;\nimport static a.B.c;\n/** The one. */\n@Service\npublic class Shop extends Base<X> implements One, Two {\n  private final Repo repo;\n  public Shop(Repo repo) { this.repo = repo; }\n  @Get(\"/x\") public List<Item> find(int id) throws E { return repo.load(id, new Item()); }\n}\ninterface Repo { Item load(int a); }\nrecord Item(int a) {}\nenum Kind { A, B }\n")
    assert f["imports"] == ["java.util.List", "a.B.c"]
    assert names(f, "class") == ["Shop"] and names(f, "interface") == ["Repo"] and names(f, "record") == ["Item"] and names(f, "enum") == ["Kind"]
    assert set(names(f, "method")) == {"find", "load"} and names(f, "constructor") == ["Shop"] and "repo" in names(f, "field")
    assert {"load", "Item"} <= {c["callee"] for c in f["calls"]}
    assert [(s["sub"], s["super"]) for s in f["supertypes"]] == [("Shop", "Base"), ("Shop", "One"), ("Shop", "Two")]
    assert not f["had_parse_error"] and extract("java", "A.java", "class A { void f( { }")["had_parse_error"]


def test_typescript():
    f = extract("typescript", "a.ts", "import { a } from './b';\nexport const useX = async (id: string): Promise<X> => { return await fetch(`/api/x/${id}`) };\ninterface P extends Q { a: string }\nexport class V extends W implements P { run(x: number): void { this.go(x) } }\nfunction top() { useX('1') }\ntype T = { a: 1 };\nenum E { A }\n")
    assert f["imports"] == ["./b"] and names(f, "function") == ["useX", "top"] and names(f, "class") == ["V"] and names(f, "method") == ["run"]
    assert names(f, "interface") == ["P"] and names(f, "type") == ["T"] and names(f, "enum") == ["E"]
    assert {"fetch", "go", "useX"} <= {c["callee"] for c in f["calls"]}
    assert {(s["sub"], s["super"]) for s in f["supertypes"]} == {("P", "Q"), ("V", "W"), ("V", "P")}


def test_csharp_and_partial():
    f = extract("csharp", "a.cs", "using System;\nusing System.Text;\nnamespace N {\n public partial class Form : Base, IThing { public int Size { get; set; } void Click(object s) { Save(new Doc()); } public Form() {} }\n class Plain {} }\n")
    assert f["imports"] == ["System", "System.Text"]
    assert [s["partial"] for s in f["symbols"] if s["kind"] == "class"] == [True, False]
    assert names(f, "property") == ["Size"] and names(f, "method") == ["Click"] and names(f, "constructor") == ["Form"]
    assert {(s["sub"], s["super"]) for s in f["supertypes"]} == {("Form", "Base"), ("Form", "IThing")}


def test_rust():
    f = extract("rust", "a.rs", "use std::fmt;\n/// A point.\npub struct P { x: i32 }\nimpl fmt::Display for P { fn fmt(&self) -> R { write(self.x) } }\npub(crate) fn make<'a>(x: &'a str) -> P { P::new(x) }\ntrait T {}\nmod m { }\n")
    assert f["imports"] == ["std::fmt"] and names(f, "struct") == ["P"] and names(f, "function") == ["fmt", "make"] and names(f, "trait") == ["T"]
    assert f["symbols"][0]["doc"] == "/// A point." and [(s["sub"], s["super"]) for s in f["supertypes"]] == [("P", "Display")]
    assert {"write", "new"} <= {c["callee"] for c in f["calls"]}


def test_spring_routes_beans_and_injection():
    text = '@RestController @RequestMapping("/api/v1/")\npublic class Ctl {\n  @Autowired private Svc svc;\n  private final Repo<User> repo;\n  public Ctl(Mail mail, @Q("x") final Log log) {}\n  @GetMapping("/users/{id}") public U one(int id) { return null; }\n  @PostMapping public U add() { return null; }\n  @RequestMapping(value = "/x", method = RequestMethod.PUT) public U put() { return null; }\n}\n@Entity @Table(name = "users") class User {}\ninterface M { @Select("select * from dbo.users u join roles r") List<U> all(); }'
    f = framework_facts("java", text)
    assert [(r["method"], r["path"], r["handler"]) for r in f["routes"]] == [("GET", "/api/v1/users/{}", "one"), ("POST", "/api/v1", "add"), ("PUT", "/api/v1/x", "put")]
    assert f["beans"] == [{"bean": "Ctl", "stereotype": "RestController"}]
    assert [i["type"] for i in f["injects"]] == ["Svc", "Repo<User>", "Mail", "Log"]
    assert f["entities"] == [{"entity": "User", "table": "users"}]
    assert [(r["table"], r["verb"]) for r in f["table_refs"]] == [("users", "select"), ("roles", "select")]


def test_python_and_csharp_routes():
    f = framework_facts("python", '@router.get("/items/{id}")\nasync def one(id): ...\n@app.route("/y", methods=["POST"])\ndef two(): ...\n@cache.get("/no")\ndef three(): ...\nclass U(Base):\n    __tablename__ = "users"\n')
    assert [(r["method"], r["path"], r["handler"]) for r in f["routes"]] == [("GET", "/items/{}", "one"), ("POST", "/y", "two")]
    assert f["entities"] == [{"entity": "U", "table": "users"}]
    g = framework_facts("csharp", '[ApiController]\n[Route("api/orders")]\npublic class O : B { [HttpGet("{id}")] public X Get(int id) { return null; } }')
    assert [(r["method"], r["path"]) for r in g["routes"]] == [("GET", "/api/orders/{}")] and g["beans"][0]["stereotype"] == "ApiController"


@pytest.mark.parametrize(
    ("lang", "text", "expected"),
    [
        ("typescript", "fetch('/api/a')", [("GET", "/api/a")]),
        ("typescript", "fetch(`/api/a/${id}`, { method: 'POST' })", [("POST", "/api/a/{}")]),
        ("typescript", "axios.delete('/api/a/' + id)", [("DELETE", "/api/a/{}")]),
        ("javascript", "axios({ url: '/api/b', method: 'put' })", [("PUT", "/api/b")]),
        ("typescript", "app.get('/api/a', (req, res) => {})", []),
        ("typescript", "items.get('key')", []),
        ("python", "requests.post(f'/api/a/{x}')", [("POST", "/api/a/{}")]),
        ("python", "client.request('PATCH', '/api/z')", [("PATCH", "/api/z")]),
        ("python", "cache.get('/api/a')", []),
        ("java", 'class A { void f() { rest.getForObject("/api/u/" + id, U.class); } }', [("GET", "/api/u/{}")]),
        ("java", 'class A { void f() { rest.exchange("/api/u", HttpMethod.PUT, e, U.class); } }', [("PUT", "/api/u")]),
        ("java", 'class A { void f() { web.get().uri("/api/w").retrieve(); } }', [("GET", "/api/w")]),
        ("java", 'class A { void f() { map.put("/api/x", 1); } }', []),
        ("java", 'class A { void f() { rest.getForObject(String.format("/api/%s/x", id), U.class); } }', [("GET", "/api/{}/x")]),
        ("csharp", 'class A { void F() { http.GetFromJsonAsync<X>($"/api/q/{id}"); } }', [("GET", "/api/q/{}")]),
    ],
)
def test_api_calls(lang, text, expected):
    assert [(c["method"], c["path"]) for c in framework_facts(lang, text)["api_calls"]] == expected


def test_constants_fill_urls():
    f = framework_facts("java", 'class A { static final String BASE = "/api/c"; void f() { rest.getForObject(BASE + "/x", U.class); rest.getForObject(Other.URL + "/y", U.class); } }')
    assert [(c["path"], c["described"]) for c in f["api_calls"]] == [("/api/c/x", "/api/c/x"), ("{}/y", "<URL>/y")]


def test_mapper_xml():
    rows = mapper_statements('<?xml?>\n<mapper namespace="a.B">\n<select id="x">select 1 from t1 <if test="a">join t2</if></select>\n<insert id="y"><selectKey>select 2</selectKey>insert into t3</insert>\n<delete id="z">delete from t4')
    assert [(r["id"], r["verb"]) for r in rows] == [("x", "select"), ("y", "insert"), ("z", "delete")]
    assert rows[0]["tables"] == [{"table": "t1", "verb": "select"}, {"table": "t2", "verb": "select"}]
    assert mapper_statements("<mapper>") == []


def test_rules():
    assert len(BUILTIN["route"]) == 17 and merged(None) == BUILTIN
    own = merged('[[framework.route]]\nlang = "java"\nannotation = "Own"\nmethod = "GET"\n')
    assert own["route"][-1]["annotation"] == "Own" and len(own["route"]) == 18
    assert merged("[framework]\nreplace_defaults = true\n")["route"] == []
    assert merged("[framework]\nreplace_defaults = true\n" + rules_toml()) == BUILTIN


def test_objects_that_serve_are_told_by_their_constructor():
    text = 'from fastapi import APIRouter\nusers = APIRouter()\nsettings = load()\n@users.get("/u")\ndef a(): ...\n@settings.get("/no")\ndef b(): ...\nusers.get("/x")\nclient.get("/api/x")\n'
    f = framework_facts("python", text)
    assert [(r["method"], r["path"], r["handler"]) for r in f["routes"]] == [("GET", "/u", "a")] and [c["path"] for c in f["api_calls"]] == ["/api/x"]
    f = framework_facts("typescript", 'const web = express();\nweb.get("/a", show);\nuserCache.get("/b");\napi.get("/api/c");\nthis.get("/d");\n')
    assert [c["path"] for c in f["api_calls"]] == ["/api/c"]
    assert not framework_facts("java", 'class A { void f() { userRepository.delete("/api/x"); } }')["api_calls"]


def test_gitignore_of_folders_above(tmp_path):
    from ctxloom.sources.files import list_tree

    for path in ("a.gen.ts", "src/x.gen.ts", "src/secret.ts", "src/keep.gen.ts", "src/deep/out/y.ts", "src/deep/z.ts", "docs/a/b/c.md", "top.md", "src/top.md", "src/a1.py", "src/ab.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / ".gitignore").write_text("# rules\n*.gen.ts\n!keep.gen.ts\nsrc/secret.ts\nout/\ndocs/**/c.md\n/top.md\na[0-9].py\n")
    (tmp_path / "src" / "deep" / ".gitignore").write_text("!out/\n")
    assert list(list_tree(str(tmp_path))) == ["src/ab.py", "src/keep.gen.ts", "src/top.md", "src/deep/z.ts", "src/deep/out/y.ts"]


def test_annotations_belong_to_their_declaration():
    f = extract("java", "A.java", "/** The one. */\n@a.b.Service\n@Route(path = {\"x\"})\npublic class Shop {\n  @Get(\"/x\")\n  public int find() { return 1; }\n  int[] sizes;\n}\n")
    assert [(s["name"], s["start_line"], s["signature"], s["doc"]) for s in f["symbols"]] == [("Shop", 2, "@a.b.Service", "/** The one. */"), ("find", 5, '@Get("/x")', None), ("sizes", 7, "int[] sizes;", None)]
    f = extract("csharp", "a.cs", "// One.\n[Route(\"a\")]\n[Own]\npublic class A { [Key]\n public int Id { get; set; } }\n")
    assert [(s["name"], s["start_line"], s["doc"]) for s in f["symbols"]] == [("A", 2, "// One."), ("Id", 4, None)]


def test_async_arrows_are_not_calls():
    f = extract("typescript", "a.ts", "const f = async (x: number): Promise<void> => { go(x) };\nasync(() => 1);\n")
    assert [c["callee"] for c in f["calls"]] == ["go", "async"]


def test_attributes_are_not_calls():
    f = extract("csharp", "a.cs", "[Own(1), N.Other(2)][Last(3)]\nclass A { [Get(\"x\")] public X F([From(\"q\")] int a) { return b[g(1)][h(2)]; } }\n")
    assert [c["callee"] for c in f["calls"]] == ["g", "h"]


@pytest.mark.parametrize(
    ("lang", "text"),
    [
        ("java", 'import a.B;\n@Service\nclass A extends C { static final String U = "/api/u"; @Get("/x") void f() { rest.getForObject(U, X.class); } }\n'),
        ("typescript", "import { a } from './b';\nclass A extends B { run() { fetch('/api/a'); } }\n"),
        ("python", '@app.get("/a")\ndef f():\n    import json\n    return [g(x) for x in requests.get("/api/b")]\nclass A(B):\n    __tablename__ = "t"\n'),
        ("python", "import json\ndef broken(:\n  x(\n"),
        ("rust", "use std::fmt;\nimpl Show for P { fn show(&self) { write(1) } }\n"),
    ],
)
def test_kinds_of_facts_do_not_hang_on_what_else_is_wanted(lang, text):
    from ctxloom.sources.framework import FRAMEWORK_KINDS, has_framework_facts

    every, web = extract(lang, "a", text), framework_facts(lang, text)
    for kind in ("symbols", "imports", "calls", "supertypes"):
        assert extract(lang, "a", text, {kind})[kind] == every[kind]
    for kind in FRAMEWORK_KINDS:
        assert framework_facts(lang, text, want={kind})[kind] == web[kind]
        assert has_framework_facts(lang, want={kind}) or not web[kind]


def test_only_wanted_facts_are_looked_for(monkeypatch):
    from ctxloom.sources import extract as E

    monkeypatch.setattr(E.Facts, "symbol", lambda *_: pytest.fail("symbols were not wanted"))
    assert E.extract("rust", "a.rs", "use std::fmt;\n", {"imports"})["imports"] == ["std::fmt"]
    monkeypatch.setattr(E.Source, "called", lambda *_: pytest.fail("calls were not wanted"))
    assert E.extract("java", "A.java", "import a.B;\nvoid f() { g(); }\n", {"imports"})["imports"] == ["a.B"]


def test_files_of_a_small_table_are_dealt_to_all_cores(spark):
    import os

    from pyspark.sql import functions as F

    from ctxloom.plans import project

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    java = project.q_extract_symbols(spark, "/root/testdata/sf0.001").where("lang = 'java'")
    assert java.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
