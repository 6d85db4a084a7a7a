"""What frameworks say in a source file: routes, beans, injections, API calls, entities and SQL tables, found by rules."""

from __future__ import annotations

import re
from collections.abc import Collection

from ctxloom.functions.text import SQL_VERBS, SQL_WORDS
from ctxloom.sources.lexer import Source
from ctxloom.sources.rules import BUILTIN, VERBS, matches

_PREFIX = re.compile(r"^[fFrRbBuU$@]+(?=[\"'`])")


def unquoted(text: str) -> str:
    """A string literal without its prefixes and quotes."""
    t = _PREFIX.sub("", text)
    for q in ('"""', "'''", '"', "'", "`"):
        if t.startswith(q):
            return t[len(q) : -len(q)] if t.endswith(q) and len(t) >= 2 * len(q) else t[len(q) :]
    return t


def route_path(raw: str) -> str:
    s = raw.strip("\"'`")
    s = re.sub(r"\$?\{[^}]*\}?", "{}", s)
    s = re.sub(r"(?<=/):[^/]*", "{}", s)
    s = s if s.startswith("/") else "/" + s
    return s.rstrip("/") or "/"


def tables_in(sql: str) -> list[tuple[str, str]]:
    low, out = sql.lower(), []
    for word, verb in SQL_VERBS:
        for m in re.finditer(r"(?<![^\W])" + word.replace(" ", r"\s+") + r"\s+([^\W][\w.]*)", low):
            name = m.group(1).rstrip(".").rsplit(".", 1)[-1]
            if len(name.encode()) >= 2 and not name[0].isdigit() and name not in SQL_WORDS and (name, verb) not in out:
                out.append((name, verb))
    return out


# ---- URL templates ----


def template_of(s: Source, a: int, b: int, constants: dict[str, str]) -> list[tuple[str, str]]:
    """The parts of the URL that the tokens a to b spell: ("lit", text), ("unk", "") or ("named", name)."""
    while b - a >= 2 and s.at(a) == "(" and s.pair.get(a) == b - 1:
        a, b = a + 1, b - 1
    pieces, start, k = [], a, a
    while k < b:
        if s.at(k) in ("(", "[", "{"):
            k = s.after(k)
            continue
        if s.at(k) == "+":
            pieces.append((start, k))
            start = k + 1
        k += 1
    pieces.append((start, b))
    if len(pieces) > 1:
        return merge([p for x, y in pieces for p in template_of(s, x, y, constants)])
    if b - a == 1 and s.kinds[a] == "string":
        return literal_parts(s.at(a), s.lang)
    words = "".join(s.at(k) for k in range(a, b))
    if re.fullmatch(r"[\w$]+(\.[\w$]+)*", words) and not words[0].isdigit():
        known = constants.get(words) or constants.get(words.rsplit(".", 1)[-1])
        return literal_parts(f'"{known}"', "java") if known else [("named", words.rsplit(".", 1)[-1])] if words.rsplit(".", 1)[-1][:1].isupper() else [("unk", "")]
    if b - a > 2 and s.at(b - 1) == ")" and re.search(r"(?i)format$", s.at(s.pair.get(b - 1, a) - 1)):
        args = s.arguments(s.pair[b - 1])
        if args and s.kinds[args[0][0]] == "string" and unquoted(s.at(args[0][0])).startswith("/"):
            return merge([p for x in re.split(r"(%[sd]|\{\w*\})", unquoted(s.at(args[0][0]))) for p in ([("unk", "")] if re.fullmatch(r"%[sd]|\{\w*\}", x) else [("lit", x)])])
    if b - a > 3 and s.lang == "python" and s.at(a + 1) == "." and s.at(a + 2) == "format" and s.kinds[a] == "string":
        return literal_parts("f" + s.at(a), "python")
    return [("unk", "")]


def literal_parts(text: str, lang: str) -> list[tuple[str, str]]:
    body = unquoted(text)
    return merge([("unk", "") if re.fullmatch(r"\$?\{[^}]*\}", x) else ("lit", x) for x in re.split(r"(\$?\{[^}]*\})", re.sub(r"(?<=/):[A-Za-z_]\w*", "{}", body)) if x])


def merge(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for tag, value in parts:
        if tag == "lit" and out and out[-1][0] == "lit":
            out[-1] = ("lit", out[-1][1] + value)
        elif tag != "lit" or value:
            out.append((tag, value))
    return out


def render(parts: list[tuple[str, str]]) -> str:
    return "".join(v if t == "lit" else "{}" for t, v in parts)


def describe(parts: list[tuple[str, str]]) -> str:
    return "".join(v if t == "lit" else f"<{v}>" if t == "named" else "{}" for t, v in parts)


def is_dynamic(parts: list[tuple[str, str]]) -> bool:
    for k, (tag, _) in enumerate(parts):
        if tag == "unk":
            left = k > 0 and parts[k - 1][0] == "lit" and parts[k - 1][1].endswith("/")
            right = k + 1 == len(parts) or parts[k + 1][0] == "lit" and parts[k + 1][1].startswith("/")
            if not (left and right):
                return True
    return False


# ---- one file ----


#: Last words of names, by our own reading of common code: objects that answer requests, and those that hold values by key.
SERVERS = {"app", "application", "server", "router", "routes", "blueprint", "bp", "mock"}
KEEPERS = {"cache", "redis", "memcached", "store", "storage", "repository", "repo", "dao", "map", "dict", "list", "set", "params", "headers", "config", "environ"}


def last_word(name: str) -> str:
    """The last word of an identifier, in lower case: of userRepository and user_repository, repository."""
    return re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", name.rstrip("_"))[-1].lower()


#: Kinds of facts, and the family of rules without which there are none of a kind.
_FAMILY = {"routes": "route", "beans": "bean", "injects": "inject", "entities": "persistence", "table_refs": "persistence", "api_calls": "http_client", "string_constants": None}
FRAMEWORK_KINDS = tuple(_FAMILY)
LEXED = ("java", "csharp", "python", "typescript", "javascript")
_BUILTIN_FOR = {lang: {k: [r for r in v if matches(r, lang)] for k, v in BUILTIN.items()} for lang in LEXED}


class Framework:
    """The framework facts of one file; kinds that are not in ``want`` may be left out."""

    def __init__(self, lang: str, text: str, rules: dict | None = None, want: Collection[str] = FRAMEWORK_KINDS, source: Source | None = None):
        self.s, self.lang = source or Source(lang, text), lang
        self.rules = _rules_for(lang, rules)
        self.members = not {"routes", "injects", "table_refs"}.isdisjoint(want)
        self.made = self._made_by() if lang in ("python", "typescript", "javascript") and not {"routes", "api_calls"}.isdisjoint(want) else {}
        self.out = no_framework_facts()
        self.constants = self._constants() if not {"api_calls", "string_constants"}.isdisjoint(want) else {}
        self.out["string_constants"] = self.constants
        if self.members or not {"beans", "entities"}.isdisjoint(want):
            if lang in ("java", "csharp"):
                self._types()
            elif lang == "python":
                self._python()
        if "api_calls" in want:
            self._api_calls()

    def _constants(self) -> dict[str, str]:
        """name -> literal of declarations whose value is one string; the first one wins, and counts under its type's name, too."""
        s, out, owner = self.s, {}, ""
        for k, x in enumerate(s.texts):
            if x in ("class", "interface", "object") and s.is_word(k + 1):
                owner = s.at(k + 1)
            if s.kinds[k] == "word" and s.at(k + 1) == "=" and k + 2 < s.n and s.kinds[k + 2] == "string" and (s.at(k + 3) in (";", ",", "}", "") or self.lang == "python" and s.line(k + 3) > s.line(k + 2) if k + 3 < s.n else True):
                value = unquoted(s.at(k + 2))
                if not re.search(r"\$?\{", value):
                    out.setdefault(s.at(k), value)
                    if owner:
                        out.setdefault(f"{owner}.{s.at(k)}", value)
        return out

    def annotations(self, k: int) -> tuple[list[tuple[str, int | None]], int]:
        """(annotations before a declaration as (name, place of the parenthesis or None), where they begin) for the declaration whose head is at k."""
        s, found = self.s, []
        while k > 0:
            j = k - 1
            if s.at(j) == "]" and self.lang == "csharp":
                open_ = s.pair.get(j, j)
                for a, _ in s.arguments(open_):
                    found.insert(0, (s.at(a), a + 1 if s.at(a + 1) == "(" else None))
                k = open_
                continue
            at = s.pair.get(j, j) - 1 if s.at(j) == ")" else j
            if s.is_word(at) and s.at(at).startswith("@"):
                found.insert(0, (s.at(at)[1:], at + 1 if at != j else None))
                k = at
                continue
            break
        return found, k

    def literal(self, paren: int | None, keys: tuple[str, ...] = ("value", "path")) -> str | None:
        """The path an annotation names: argument ``value`` or ``path``, else its first string."""
        if paren is None:
            return None
        s, end = self.s, self.s.pair.get(paren, paren)
        for k in range(paren + 1, end):
            if s.at(k) in keys and s.at(k + 1) == "=":
                for j in range(k + 2, end):
                    if s.kinds[j] == "string":
                        return unquoted(s.at(j))
        return next((unquoted(s.at(k)) for k in range(paren + 1, end) if s.kinds[k] == "string"), None)

    def _types(self) -> None:
        s = self.s
        for k, x in enumerate(s.texts):
            if x not in ("class", "interface", "record", "struct") or not s.is_word(k + 1) or s.at(k - 1) in (".", "new"):
                continue
            name, head = s.at(k + 1), k
            while head and s.at(head - 1) in ("public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "partial"):
                head -= 1
            notes, _ = self.annotations(head)
            open_ = next((j for j in range(k + 2, s.n) if s.at(j) in ("{", ";")), s.n)
            base = ""
            for n, p in notes:
                if any(r["annotation"] == n for r in self.rules["base_path"]):
                    path = self.literal(p)
                    base = route_path(path) if path else ""
                    base = "" if base == "/" else base
                    break
            stereotype = next((n for n, _ in notes if any(n in r["annotations"] for r in self.rules["bean"])), None)
            if stereotype:
                self.out["beans"].append({"bean": name, "stereotype": stereotype})
            for r in self.rules["persistence"]:
                tables = [self.literal(p, ("name",)) for n, p in notes if n == r.get("table")]
                if r.get("entity") and (any(n == r["entity"] for n, _ in notes) or tables):
                    self.out["entities"].append({"entity": name, "table": next((t for t in tables if t), None)})
            if self.members and s.at(open_) == "{":
                self._members(name, open_, s.pair.get(open_, s.n), base, stereotype is not None)

    def _members(self, owner: str, open_: int, close: int, base: str, bean: bool) -> None:
        s, k = self.s, open_ + 1
        mods = ("public", "private", "protected", "internal", "static", "final", "abstract", "async", "override", "virtual", "readonly", "default", "synchronized")
        while k < close:
            notes: list[tuple[str, int | None]] = []
            while k < close:
                if s.at(k).startswith("@") and len(s.at(k)) > 1 and s.at(k) != "@interface":
                    paren = k + 1 if s.at(k + 1) == "(" else None
                    notes.append((s.at(k)[1:], paren))
                    k = s.after(paren) if paren else k + 1
                elif self.lang == "csharp" and s.at(k) == "[":
                    notes += [(s.at(a), a + 1 if s.at(a + 1) == "(" else None) for a, _ in s.arguments(k)]
                    k = s.after(k)
                else:
                    break
            first, j, words = k, k, []
            while j < close and s.at(j) not in ("(", ";", "{", "=", "=>", "}"):
                if s.at(j) == "<":
                    j = max(s.skip_angles(j), j + 1)
                    continue
                if s.is_word(j) and s.at(j) not in mods:
                    words.append(j)
                j += 1
            final = "final" in [s.at(q) for q in range(first, j)]
            static = "static" in [s.at(q) for q in range(first, j)]
            if s.at(j) == "(" and words:
                self._method(owner, s.at(words[-1]), notes, j, base, bean and s.at(words[-1]) == owner and len(words) == 1)
                j = s.after(j)
                while j < close and s.at(j) not in ("{", ";", "=>"):
                    j += 1
                if s.at(j) == "=>":
                    while j < close and s.at(j) != ";":
                        j = s.after(j) if s.at(j) in ("(", "{", "[") else j + 1
                k = s.after(j) if s.at(j) == "{" else j + 1
            elif s.at(j) in ("=", ";") and len(words) >= 2:
                kind = s.text[s.starts[words[-2]] : s.starts[words[-1]]].strip()
                for r in self.rules["inject"]:
                    if bean and (any(n in r["annotations"] for n, _ in notes) or r.get("final_fields") and final and not static):
                        self.out["injects"].append({"owner": owner, "type": kind})
                        break
                while j < close and s.at(j) != ";":
                    j = s.after(j) if s.at(j) in ("(", "{", "[") else j + 1
                k = j + 1
            else:
                k = s.after(j) if s.at(j) in ("{", "(") else j + 1

    def _method(self, owner: str, name: str, notes: list, paren: int, base: str, constructor: bool) -> None:
        s = self.s
        for n, p in notes:
            rule = next((r for r in self.rules["route"] if r["annotation"] == n), None)
            if rule:
                method = rule["method"]
                raw = s.text[s.starts[p] : s.end(s.pair.get(p, p))] if p else ""
                if rule.get("method_prefix") and (m := re.search(re.escape(rule["method_prefix"]) + r"([A-Za-z]+)", raw)):
                    method = m.group(1).upper()
                path = self.literal(p)
                tail = route_path(path) if path else ""
                self.out["routes"].append({"method": method, "path": (base + ("" if tail == "/" else tail)) or "/", "handler": name, "owner": owner})
            for r in self.rules["persistence"]:
                if n in r.get("sql", ()) and p:
                    raw = s.text[s.starts[p] : s.end(s.pair.get(p, p))]
                    self.out["table_refs"] += [{"owner": owner, "table": t, "verb": v} for t, v in tables_in(raw)]
        if constructor and any(r.get("constructor_params") for r in self.rules["inject"]):
            for a, b in s.arguments(paren):
                names = [k for k in range(a, b) if s.is_word(k) and not s.at(k).startswith("@") and s.at(k) != "final"]
                if len(names) >= 2:
                    self.out["injects"].append({"owner": owner, "type": s.text[s.starts[names[0]] : s.starts[b - 1]].strip()})

    def _made_by(self) -> dict[str, str]:
        """What each name of the file is assigned from: the last word before the parentheses of a call, '' for anything else."""
        s, out = self.s, {}
        for k in range(1, s.n - 1):
            if s.texts[k] != "=" or not s.is_word(k - 1):
                continue
            j = k + 1
            while s.at(j) in ("new", "await"):
                j += 1
            while s.is_word(j) and s.at(j + 1) == ".":
                j += 2
            out[s.at(k - 1)] = s.at(j) if s.is_word(j) and s.at(j + 1) == "(" else ""
        return out

    def _serves(self, rule: dict, name: str, path: str | None) -> bool:
        """Whether a decorator on ``name`` registers a route: the name is one that the rule lists, or made by a router's constructor, or comes from elsewhere, reads like a server's and is given a path."""
        if "receivers" in rule:
            return name.lower() in rule["receivers"]
        made = self.made.get(name)
        return made in rule.get("constructors", ()) or made is None and last_word(name) in {*SERVERS, "api"} and (path or "/").startswith("/")

    def _calls_out(self, rule: dict, receiver: str) -> bool:
        """Whether what stands before a call's dot can be a client: not a decorator, not the object itself, nothing that serves, nothing that keeps values under keys."""
        if receiver.startswith("@") or receiver.lower() in rule.get("exclude", ()) or self.made.get(receiver) in rule.get("registers", ()):
            return False
        if rule.get("receiver") and (receiver in ("this", "self") or last_word(receiver) in SERVERS and receiver not in self.made):
            return False
        return not (rule.get("receiver") or rule["call"] == "delete") or last_word(receiver) not in KEEPERS

    def _python(self) -> None:
        s = self.s
        for k, x in enumerate(s.texts):
            if x[0] == "@" and len(x) > 1 and s.at(k + 1) == "." and s.is_word(k + 2) and s.at(k + 3) == "(":
                end = s.after(k + 3)
                path = next((unquoted(s.at(j)) for j in range(k + 4, end) if s.kinds[j] == "string"), None)
                rule = next((r for r in self.rules["route"] if r["annotation"] == s.at(k + 2) and self._serves(r, x[1:], path)), None)
                if not rule:
                    continue
                path, method = path or "/", rule["method"]
                for j in range(k + 4, end):
                    if s.at(j) == rule.get("methods_key") and s.at(j + 1) == "=":
                        method = next((unquoted(s.at(q)).upper() for q in range(j + 2, end) if s.kinds[q] == "string"), method)
                j = end
                while j < s.n and s.at(j) != "def" and j < end + 200:
                    j += 1
                self.out["routes"].append({"method": method, "path": route_path(path), "handler": s.at(j + 1), "owner": None})
            elif x == "class" and s.is_word(k + 1):
                for r in self.rules["persistence"]:
                    name = r.get("table_attribute")
                    for j in range(k + 2, min(k + 400, s.n)):
                        if s.at(j) == "class":
                            break
                        if name and s.at(j) == name and s.at(j + 1) == "=" and s.kinds[j + 2] == "string":
                            self.out["entities"].append({"entity": s.at(k + 1), "table": unquoted(s.at(j + 2))})
                            break

    # ---- API calls ----

    def _receiver(self, k: int) -> tuple[str, int | None]:
        """(text of what stands before the dot at k - 1, place of the call's name if it is a call)."""
        s, j = self.s, k - 2
        end = j
        call = None
        while j >= 0:
            if s.at(j) in (")", "]", ">"):
                o = s.pair.get(j, j)
                if s.at(j) == ")" and call is None and j == end:
                    call = o - 1
                j = o - 1
                if s.at(j) == ">":
                    continue
            if s.is_word(j):
                if s.at(j - 1) in (".", "?.", "!"):
                    j -= 2 if s.at(j - 1) != "!" else 1
                    continue
                if s.at(j - 1) in ("new", "await"):
                    j -= 1
                break
            if s.kinds[j] == "string":
                break
            break
        j = max(j, 0)
        return s.text[s.starts[j] : s.end(end)] if end >= 0 else "", call

    def _api_calls(self) -> None:
        s = self.s
        clients: dict[str, list[dict]] = {}
        for r in self.rules["http_client"]:
            clients.setdefault(r["call"], []).append(r)
        for k, paren in s.called():
            if s.texts[k] not in clients:
                continue
            with_receiver = s.at(k - 1) in (".", "?.")
            receiver, call = self._receiver(k) if with_receiver else ("", None)
            for r in clients[s.texts[k]]:
                if r.get("receiver") and not with_receiver or r.get("bare") and with_receiver:
                    continue
                if not self._calls_out(r, receiver) or r.get("chain") and (call is None or s.at(call) not in r["chain"]):
                    continue
                if not with_receiver and not r.get("bare") and self.lang != "csharp" and not (self.lang == "java" and r.get("method")):
                    continue
                if found := self._call(r, k, paren, call):
                    self.out["api_calls"].append(found | {"line": s.line(k)})
                break

    def _call(self, r: dict, k: int, paren: int, call: int | None) -> dict | None:
        s, args = self.s, self.s.arguments(paren)
        for a, b in args:  # a function as an argument: a handler is registered here, nothing is called
            if any(s.at(j) in ("=>", "->", "function", "lambda") for j in range(a, b) if not self._inside_object(a, j)):
                return None
        option = lambda key: next(((j + 2, self._value_end(j + 2)) for a, b in args for j in range(a, b) if s.at(a) == "{" and (s.at(j) == key or s.kinds[j] == "string" and unquoted(s.at(j)) == key) and s.at(j + 1) == ":"), None)
        method = None
        if r.get("option") and (o := option(r["option"])):
            method = unquoted(s.at(o[0])).upper() if s.kinds[o[0]] == "string" else None
            if method is None:
                return None
        if method is None and "method_arg" in r:
            if len(args) <= r["method_arg"]:
                return None
            a, b = args[r["method_arg"]]
            words = unquoted(s.at(b - 1)).upper()
            if words not in VERBS:
                return None
            method = words
        if method is None and r.get("chain") and call is not None:
            method = s.at(call).upper()
        method = method or r.get("method") or re.sub(r"(?i)async$", "", r["call"]).upper()
        if method not in VERBS:
            return None
        where = option(r["url_option"]) if r.get("url_option") else None
        if where is None:
            at = r.get("url", 0)
            if len(args) <= at or s.at(args[at][0]) == "{":
                return None
            a, b = args[at]
            if self.lang == "python" and s.at(a + 1) == "=" and s.is_word(a):
                a += 2
            where = (a, b)
        parts = template_of(s, *where, self.constants)
        if not any(t != "unk" for t, _ in parts):
            return None
        path = render(parts)
        if not any(t == "named" for t, _ in parts) and not (path.startswith("/") or "/api" in path):
            return None
        return {"method": method, "path": path, "dynamic": is_dynamic(parts), "described": describe(parts), "template": [{"tag": t, "value": v} for t, v in parts]}

    def _inside_object(self, a: int, j: int) -> bool:
        return self.s.at(a) == "{" and a < j

    def _value_end(self, k: int) -> int:
        s = self.s
        while k < s.n and s.at(k) not in (",", "}"):
            k = s.after(k) if s.at(k) in ("(", "[", "{") else k + 1
        return k


def no_framework_facts() -> dict:
    return {k: {} if k == "string_constants" else [] for k in FRAMEWORK_KINDS}


def _rules_for(lang: str, rules: dict | None) -> dict[str, list[dict]]:
    """The rules that hold for a language; the built-in ones are picked once."""
    return _BUILTIN_FOR[lang] if not rules else {k: [r for r in v if matches(r, lang)] for k, v in rules.items()}


def has_framework_facts(lang: str, rules: dict | None = None, want: Collection[str] = FRAMEWORK_KINDS) -> bool:
    """Whether files in a language can have facts of the kinds in ``want``: there are rules for them. String constants need none."""
    if lang not in LEXED:
        return False
    of = _rules_for(lang, rules)
    return any(_FAMILY[k] is None or of[_FAMILY[k]] for k in want)


def framework_facts(lang: str, text: str, rules: dict | None = None, want: Collection[str] = FRAMEWORK_KINDS, source: Source | None = None) -> dict:
    """routes, beans, injects, entities, table_refs, api_calls and string_constants of one file; none for languages without a lexer.

    Kinds that are not in ``want`` may be left out; ``source`` is the text's, if it is known.
    """
    return Framework(lang, text, rules, want, source).out if lang in LEXED else no_framework_facts()


def mapper_statements(xml: str) -> list[dict]:
    """Statements of an SQL mapper file: id, verb, tables, start_line and end_line; files without a mapper and a namespace have none."""
    head = re.search(r"<mapper\b[^>]*\bnamespace\s*=\s*[\"']([^\"']+)[\"']", xml)
    if not head:
        return []
    out = []
    for m in re.finditer(r"<(select|insert|update|delete)\b(?![\w-])([^>]*)>", xml):
        end = xml.find(f"</{m.group(1)}>", m.end())
        stop = len(xml) if end < 0 else end + len(m.group(1)) + 3
        name = re.search(r"\bid\s*=\s*[\"']([^\"']+)[\"']", m.group(2))
        body = re.sub(r"<[^>]+>", " ", xml[m.end() : stop if end < 0 else end])
        out.append({"namespace": head.group(1), "id": name.group(1) if name else "", "verb": m.group(1), "tables": [{"table": t, "verb": v} for t, v in tables_in(body)], "start_line": xml.count("\n", 0, m.start()) + 1, "end_line": xml.count("\n", 0, stop) + 1})
    return out
