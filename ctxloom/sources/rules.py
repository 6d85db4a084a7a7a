"""Rules that tell frameworks' routes, beans, injections, HTTP clients and persistence. They are data: user rules go after the built-in ones, or in their place."""

from __future__ import annotations

import tomllib

#: Names that the frameworks and client libraries themselves define.
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
#: What makes an object that registers routes: FastAPI, Flask and Quart, Sanic; Express, Koa's router, Fastify.
PYTHON_ROUTERS = ["FastAPI", "APIRouter", "Flask", "Blueprint", "Quart", "Sanic"]
SCRIPT_ROUTERS = ["express", "Router", "fastify", "Fastify"]
#: Methods of HttpClient and its JSON extensions.
CSHARP_CLIENT = {
    "GetAsync": "GET",
    "GetStringAsync": "GET",
    "GetByteArrayAsync": "GET",
    "GetStreamAsync": "GET",
    "GetFromJsonAsync": "GET",
    "PostAsync": "POST",
    "PostAsJsonAsync": "POST",
    "PutAsync": "PUT",
    "PutAsJsonAsync": "PUT",
    "DeleteAsync": "DELETE",
    "DeleteFromJsonAsync": "DELETE",
    "PatchAsync": "PATCH",
    "PatchAsJsonAsync": "PATCH",
}
#: Methods of RestTemplate that fix the verb.
JAVA_CLIENT = {
    "getForObject": "GET",
    "getForEntity": "GET",
    "postForObject": "POST",
    "postForEntity": "POST",
    "postForLocation": "POST",
    "patchForObject": "PATCH",
    "delete": "DELETE",
}


def _builtin() -> dict[str, list[dict]]:
    """Whether an object serves or calls is told by what made it in the file (``constructors``, ``registers``), not by what it is called."""
    route = [{"lang": "java", "annotation": f"{v.title()}Mapping", "method": v} for v in VERBS[:5]]
    route.append({"lang": "java", "annotation": "RequestMapping", "method": "ANY", "method_prefix": "RequestMethod."})
    route += [{"lang": "python", "annotation": v.lower(), "method": v, "constructors": PYTHON_ROUTERS} for v in VERBS[:5]]
    route.append({"lang": "python", "annotation": "route", "method": "ANY", "constructors": PYTHON_ROUTERS, "methods_key": "methods"})
    route += [{"lang": "csharp", "annotation": f"Http{v.title()}", "method": v} for v in VERBS[:5]]
    client: list[dict] = [{"lang": "java", "call": n, "method": v, "url": 0} for n, v in JAVA_CLIENT.items()]
    client += [{"lang": "java", "call": n, "method_arg": 1, "url": 0} for n in ("exchange", "execute")]
    client.append({"lang": "java", "call": "uri", "chain": [v.lower() for v in VERBS], "url": 0})
    client += [{"lang": "python", "call": v.lower(), "url": 0, "receiver": True, "registers": PYTHON_ROUTERS} for v in VERBS[:5]]
    client.append({"lang": "python", "call": "request", "method_arg": 0, "url": 1, "receiver": True, "registers": PYTHON_ROUTERS})
    client.append({"lang": "typescript", "call": "fetch", "method": "GET", "option": "method", "url": 0, "bare": True})
    client.append({"lang": "typescript", "call": "axios", "method": "GET", "option": "method", "url_option": "url", "url": 0, "bare": True})
    client.append({"lang": "typescript", "call": "request", "method": "GET", "option": "method", "url_option": "url", "url": 0, "receiver": True, "registers": SCRIPT_ROUTERS})
    client += [{"lang": "typescript", "call": v.lower(), "url": 0, "receiver": True, "registers": SCRIPT_ROUTERS} for v in VERBS]
    client += [{"lang": "csharp", "call": n, "method": v, "url": 0} for n, v in CSHARP_CLIENT.items()]
    return {
        "route": route,
        "base_path": [{"lang": "java", "annotation": "RequestMapping"}, {"lang": "csharp", "annotation": "Route"}],
        "bean": [{"lang": "java", "annotations": ["RestController", "Controller", "Service", "Repository", "Component", "Configuration"]}, {"lang": "csharp", "annotations": ["ApiController", "Controller"]}],
        "inject": [{"lang": "java", "annotations": ["Autowired", "Inject"], "final_fields": True, "constructor_params": True}],
        "http_client": client,
        "persistence": [{"lang": "java", "entity": "Entity", "table": "Table", "sql": ["Select", "Insert", "Update", "Delete", "SelectProvider"], "repositories": ["JpaRepository", "CrudRepository", "MongoRepository"]}, {"lang": "python", "table_attribute": "__tablename__"}],
    }


BUILTIN = _builtin()


def merged(text: str | None) -> dict[str, list[dict]]:
    """The built-in rules and those of a TOML text under [[framework.*]]; ``replace_defaults = true`` leaves the built-in ones out."""
    own = tomllib.loads(text).get("framework", {}) if text else {}
    base = {k: [] for k in BUILTIN} if own.get("replace_defaults") else BUILTIN
    return {k: [*base[k], *own.get(k, [])] for k in BUILTIN}


def matches(rule: dict, lang: str) -> bool:
    """Rules of TypeScript and JavaScript hold for both."""
    same = {"javascript": "typescript"}
    return same.get(rule["lang"], rule["lang"]) == same.get(lang, lang)


def rules_toml(rules: dict[str, list[dict]] = BUILTIN) -> str:
    show = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "[" + ", ".join(f'"{x}"' for x in v) + "]" if isinstance(v, list) else f'"{v}"'
    return "\n".join(f"[[framework.{k}]]\n" + "".join(f"{n} = {show(v)}\n" for n, v in r.items()) for k, rs in rules.items() for r in rs)
