"""Facts of a source file: symbols, imports, calls and supertypes, for Python, Java, TypeScript and JavaScript, C# and Rust.

``extract`` is tolerant: a file that does not parse gives what can be found, and had_parse_error.
"""

from __future__ import annotations

import ast
import json
from collections import deque
from collections.abc import Collection, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ctxloom.functions.text import PARSED
from ctxloom.sources.framework import FRAMEWORK_KINDS, framework_facts, has_framework_facts, no_framework_facts
from ctxloom.sources.lexer import Source

SYMBOL = "struct<name:string,kind:string,start_line:int,end_line:int,signature:string,doc:string,partial:boolean>"
FACTS = f"symbols array<{SYMBOL}>, imports array<string>, calls array<struct<callee:string,line:int>>, supertypes array<struct<sub:string,super:string>>, had_parse_error boolean"
KINDS = ("symbols", "imports", "calls", "supertypes")
#: Words before a parenthesis that are not calls.
NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "synchronized", "using", "lock", "foreach", "fixed", "sizeof", "typeof", "function", "match", "fn", "super", "this", "await", "constructor", "when", "in", "not", "and", "or", "lambda", "elif", "except", "nameof", "where", "throw", "new", "else", "do", "try", "assert", "yield", "del", "impl", "loop", "move", "pub"}
MODIFIERS = {"public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "readonly", "override", "virtual", "async", "extern", "unsafe", "new", "partial", "default", "synchronized", "native", "export", "declare", "pub", "const", "transient", "volatile", "strictfp", "get", "set"}
SCRIPT_HEADS = {"import", "export", "function", "class", "interface", "enum", "type", "const", "let", "var"}
TYPES = {"java": ("class", "interface", "enum", "record"), "csharp": ("class", "interface", "struct", "record", "enum")}


def empty() -> dict:
    return {"symbols": [], "imports": [], "calls": [], "supertypes": [], "had_parse_error": False}


def _signature(text: str) -> str:
    line = text.strip().split("\n", 1)[0].strip()
    return line if len(line) <= 200 else line[:200] + "…"


class Facts:
    """What is found in one source; facts that are not in ``want`` may be left out."""

    def __init__(self, source: Source, want: Collection[str] = KINDS):
        self.s, self.out, self.declared, self.want = source, empty() | {"had_parse_error": source.broken}, set(), want

    def symbol(self, kind: str, name: int, first: int, last: int, partial: bool = False) -> None:
        self.declared.add(name)
        if "symbols" not in self.want:
            return
        s = self.s
        last = min(max(last, first), s.n - 1)
        text = s.text[s.starts[first] : s.end(last)]
        end = s.line(last) + s.texts[last].count("\n")
        self.out["symbols"].append({"name": s.texts[name], "kind": kind, "start_line": s.line(first), "end_line": end, "signature": _signature(text), "doc": s.doc_before(first), "partial": partial})

    def supers(self, sub: str, k: int, stops: tuple[str, ...]) -> None:
        """Type names in a list from k on, up to one of ``stops``; arguments in angle brackets or parentheses are passed over."""
        name = ""
        while k < self.s.n and self.s.at(k) not in stops:
            x = self.s.at(k)
            if x == "<":
                k = max(self.s.skip_angles(k), k + 1)
                continue
            if x == "(":
                k = self.s.after(k)
                continue
            if x == ",":
                self._super(sub, name)
                name = ""
            elif self.s.is_word(k):
                name = x
            k += 1
        self._super(sub, name)

    def _super(self, sub: str, name: str) -> None:
        if name and name != sub:
            self.out["supertypes"].append({"sub": sub, "super": name})

    def attributes(self) -> set[int]:
        """Places of the attributes' names in C#; their arguments look like those of calls."""
        s, found, closed = self.s, set(), set()
        for k in range(s.n):
            end = s.pair.get(k)
            if s.at(k) != "[" or end is None or not (k == 0 or k - 1 in closed or s.at(k - 1) in ("{", "}", ";", "(", ",")):
                continue
            if s.at(end + 1) != "[" and not s.is_word(end + 1):
                continue
            closed.add(end)
            j = k + 1
            while j < end:
                if s.at(j - 1) in ("[", ",", ".", ":") and s.is_word(j):
                    found.add(j)
                j = s.after(j) if s.at(j) in ("(", "[", "{") else j + 1
        return found

    def calls(self) -> None:
        if "calls" not in self.want:
            return
        s = self.s
        if s.lang == "csharp":
            self.declared |= self.attributes()
        for k, n in s.called():
            x = s.texts[k]
            if k in self.declared or x in NOT_CALLED and not (s.lang == "rust" and x == "new") or x.startswith("@"):
                continue
            if not (x == "async" and _arrow_after(s, s.after(n))):
                self.out["calls"].append({"callee": x, "line": s.line(k)})

    def body_end(self, k: int) -> int:
        """The last token of a declaration whose head goes on at k: its block, or the semicolon."""
        s = self.s
        while k < s.n:
            x = s.at(k)
            if x == "{":
                return s.after(k) - 1
            if x == ";":
                return k
            if x in ("(", "["):
                k = s.after(k)
                continue
            if x == "}":
                return k - 1
            k += 1
        return s.n - 1


def _head(s: Source, k: int) -> int:
    """The first token of a declaration at k: its modifiers, not its annotations."""
    while k and s.at(k - 1) in MODIFIERS:
        k -= 1
    return k


def _annotated_head(s: Source, k: int, opens: dict[int, int]) -> int:
    """The first token of a declaration at k, annotations and attributes among its modifiers; ``opens`` maps closing brackets to opening ones."""
    while True:
        k = _head(s, k)
        j = opens.get(k - 1, k)
        if j < k and s.at(j) == "[":
            k = j
            continue
        j -= 1
        while j > 1 and s.at(j - 1) == ".":
            j -= 2
        if j < 0 or not s.at(j).startswith("@") or s.at(j) in ("@", "@interface"):
            return k
        k = j


def _java_like(s: Source, want: Collection[str] = KINDS) -> dict:
    lang, f = s.lang, Facts(s, want)
    types = TYPES[lang]
    n = s.n
    opens = {close: open_ for open_, close in s.pair.items()}
    bodies: list[tuple[int, int, str]] = []
    heads = {"import", "using", *types}
    for k, x in enumerate(s.texts):
        if x not in heads:
            continue
        if x in ("import", "using") and s.is_word(k + 1) and (k == 0 or s.at(k - 1) in (";", "}")) and not any(a < k < b for a, b, _ in bodies):
            j = k + 1
            j += s.at(j) == "static"
            name = ""
            while j < n and s.at(j) not in (";", "="):
                name += s.at(j)
                j += 1
            if s.at(j) == ";":
                f.out["imports"].append(name)
        if x in types and s.is_word(k + 1) and s.at(k - 1) not in (".", "new", "::") and not (x == "record" and s.at(k + 2) not in ("(", "<", "{", ":")):
            name = k + 1 + (x == "record" and s.at(k + 1) in ("class", "struct"))
            if name in f.declared or s.at(k - 1) == "record":
                continue
            first, last = _annotated_head(s, k, opens), f.body_end(name + 1)
            f.symbol(x, name, first, last, lang == "csharp" and "partial" in [s.at(j) for j in range(first, k)])
            open_ = next((j for j in range(name + 1, min(last + 1, n)) if s.at(j) == "{"), None)
            if open_ is not None:
                bodies.append((open_, s.pair.get(open_, n), s.at(name)))
            j = name + 1
            while j < (open_ or last):
                if s.at(j) in ("extends", "implements") or lang == "csharp" and s.at(j) == ":":
                    f.supers(s.at(name), j + 1, ("{", ";", "implements", "extends", "where", "permits"))
                    if s.at(j) == ":":
                        break
                j = s.after(j) if s.at(j) == "(" else max(s.skip_angles(j), j + 1) if s.at(j) == "<" else j + 1
    if not {"symbols", "calls"}.isdisjoint(want):
        for open_, close, owner in bodies:
            _members(f, open_, close, owner, lang)
    f.calls()
    return f.out


def _members(f: Facts, open_: int, close: int, owner: str, lang: str) -> None:
    """Methods, constructors, fields and properties directly in a type's body."""
    s, k = f.s, open_ + 1
    while k < close:
        start = k
        while k < close and (s.at(k).startswith("@") and len(s.at(k)) > 1 or lang == "csharp" and s.at(k) == "["):
            if s.at(k) == "[":
                k = s.after(k)
                continue
            k += 1
            while s.at(k) == ".":
                k += 2
            if s.at(k) == "(":
                k = s.after(k)
        first, name, j = k, None, k
        while j < close and s.at(j) not in ("(", ";", "{", "=", "=>", "}"):
            if s.at(j) == "<":
                j = max(s.skip_angles(j), j + 1)
                continue
            if s.at(j) == "[":
                j = s.after(j)
                continue
            if s.at(j) in TYPES[lang]:
                break
            if s.is_word(j) and s.at(j) not in MODIFIERS:
                name = j
            j += 1
        x = s.at(j)
        words = sum(s.is_word(q) and s.at(q) not in MODIFIERS for q in range(first, j))
        if x in TYPES[lang]:
            k = f.body_end(j + 1) + 1
        elif x == "(" and name is not None and name not in f.declared:
            end = f.body_end(s.after(j))
            f.symbol("constructor" if s.at(name) == owner else "method", name, start, end)
            k = end + 1
        elif x in ("=", ";", "=>") and name is not None and words >= 2:
            end = j
            while end < close and s.at(end) != ";":
                end = s.after(end) if s.at(end) in ("(", "[", "{") else end + 1
            f.symbol("property" if x == "=>" else "field", name, start, end)
            k = end + 1
        elif x == "{" and name is not None and words >= 2 and lang == "csharp":
            end = s.after(j) - 1
            if s.at(end + 1) == "=":
                end = f.body_end(end + 1)
            f.symbol("property", name, start, end)
            k = end + 1
        elif x == "{":
            k = s.after(j)
        else:
            k = j + 1


def _typescript(s: Source, want: Collection[str] = KINDS) -> dict:
    f, n = Facts(s, want), s.n
    for k, x in enumerate(s.texts):
        if x not in SCRIPT_HEADS or s.at(k - 1) == ".":
            continue
        if x == "import" or x == "export" and "from" in (s.at(j) for j in range(k + 1, min(k + 40, n)) if s.at(j) != ";"):
            for j in range(k + 1, min(k + 60, n)):
                if s.kinds[j] == "string" and (s.at(j - 1) in ("from", "import", "(")):
                    f.out["imports"].append(s.at(j).strip("\"'`"))
                    break
                if s.at(j) == ";":
                    break
        if x == "function" and s.is_word(k + 1 + (s.at(k + 1) == "*")):
            name = k + 1 + (s.at(k + 1) == "*")
            f.symbol("function", name, _head(s, k), f.body_end(name + 1))
        elif x in ("class", "interface", "enum") and s.is_word(k + 1) and s.at(k + 1) != "extends":
            first, last = _head(s, k), f.body_end(k + 2)
            f.symbol(x, k + 1, first, last)
            open_ = next((j for j in range(k + 2, min(last + 1, n)) if s.at(j) == "{"), last)
            j = k + 2
            while j < open_:
                if s.at(j) in ("extends", "implements"):
                    f.supers(s.at(k + 1), j + 1, ("{", "implements", "extends"))
                j = max(s.skip_angles(j), j + 1)
            if x == "class":
                _ts_methods(f, open_, s.pair.get(open_, n))
        elif x == "type" and s.is_word(k + 1) and s.at(s.skip_angles(k + 2)) == "=":
            f.symbol("type", k + 1, _head(s, k), f.body_end(k + 2))
        elif x in ("const", "let", "var") and s.is_word(k + 1):
            j = k + 2
            while j < n and s.at(j) not in ("=", ";", ",", "of", "in", ")"):
                j = s.after(j) if s.at(j) in ("(", "{", "[") else max(s.skip_angles(j), j + 1)
            if s.at(j) != "=":
                continue
            j += 1 + (s.at(j + 1) == "async")
            arrow = s.at(j) == "function" or s.at(j) == "(" and _arrow_after(s, s.after(j)) or s.at(j) == "<" and s.at(s.skip_angles(j)) == "(" or s.is_word(j) and s.at(j + 1) == "=>"
            if arrow:
                end = f.body_end(j)
                f.symbol("function", k + 1, _head(s, k), end)
    f.calls()
    return f.out


def _arrow_after(s: Source, k: int) -> bool:
    """Whether => follows a parameter list, perhaps after a result type."""
    if s.at(k) == "=>":
        return True
    if s.at(k) != ":":
        return False
    while k < s.n and s.at(k) not in ("=>", ";", "=", ")", "}"):
        k = s.after(k) if s.at(k) in ("{", "[", "(") else max(s.skip_angles(k), k + 1)
    return s.at(k) == "=>"


def _ts_methods(f: Facts, open_: int, close: int) -> None:
    s, k = f.s, open_ + 1
    while k < close:
        x = s.at(k)
        if s.is_word(k) and s.at(s.skip_angles(k + 1)) == "(" and x not in NOT_CALLED - {"constructor", "get", "set"}:
            j = s.after(s.skip_angles(k + 1))
            while j < close and s.at(j) not in ("{", ";", "}", "="):
                j = max(s.skip_angles(j), j + 1)
            if s.at(j) == "{":
                f.symbol("method", k, _head(s, k), s.after(j) - 1)
                k = s.after(j)
                continue
            f.declared.add(k)
            k = j + 1
        elif x in ("(", "[", "{"):
            k = s.after(k)
        else:
            k += 1


def _rust(s: Source, want: Collection[str] = KINDS) -> dict:
    f = Facts(s, want)
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "type": "type", "const": "const", "static": "const"}
    for k, x in enumerate(s.texts):
        if x in kinds and s.is_word(k + 1) and s.at(k + 1) not in ("fn", "unsafe", "async") and s.at(k - 1) not in ("*", "<"):
            name = k + 1 + (s.at(k + 1) == "mut")
            first = k
            while first and (s.at(first - 1) in ("pub", "async", "unsafe", "const", "extern") or s.at(first - 1) == ")" and s.at(s.pair.get(first - 1, 0) - 1) == "pub"):
                first = s.pair[first - 1] - 1 if s.at(first - 1) == ")" else first - 1
            f.symbol(kinds[x], name, first, f.body_end(name + 1))
        elif x == "use":
            name, j = "", k + 1
            while j < s.n and s.at(j) != ";":
                name += s.at(j) if s.at(j) != "as" else " as "
                j += 1
            f.out["imports"].append(name)
        elif x == "impl" and (k == 0 or s.at(k - 1) in ("}", ";", "unsafe", "]", "default", "{")):
            j, names = s.skip_angles(k + 1), [""]
            while j < s.n and s.at(j) not in ("{", "where", ";"):
                if s.at(j) == "for":
                    names.append("")
                elif s.at(j) == "<":
                    j = max(s.skip_angles(j), j + 1)
                    continue
                elif s.is_word(j) and s.at(j) not in ("dyn", "mut"):
                    names[-1] = s.at(j)
                j += 1
            if len(names) == 2 and all(names):
                f._super(names[1], names[0])
    f.calls()
    return f.out


def _walk(tree: ast.AST, expressions: bool) -> Iterator[ast.AST]:
    """The nodes of a tree, level by level as ast.walk gives them; expressions hold calls only."""
    left = ast.expr_context if expressions else ast.expr
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        yield node
        for v in node.__dict__.values():
            if isinstance(v, list):
                todo.extend(x for x in v if isinstance(x, ast.AST) and not isinstance(x, left))
            elif isinstance(v, ast.AST) and not isinstance(v, left):
                todo.append(v)


def _python(text: str, want: Collection[str] = KINDS) -> dict:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_words(text, want)
    out, lines = empty(), text.split("\n")

    def callee(x: ast.expr) -> str | None:
        return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None

    for node in _walk(tree, "calls" in want):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            if "symbols" in want:
                above = node.lineno - min([node.lineno, *(d.lineno for d in node.decorator_list)])
                before, k = [], node.lineno - 2 - above
                while k >= 0 and lines[k].strip().startswith("#"):
                    before.insert(0, lines[k].strip())
                    k -= 1
                doc = "\n".join(before) or ast.get_docstring(node)
                out["symbols"].append({"name": node.name, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "signature": _signature(lines[node.lineno - 1]), "doc": doc[:500] if doc else None, "partial": False})
            if kind == "class":
                for b in node.bases:
                    name = callee(b)
                    if name and name != node.name:
                        out["supertypes"].append({"sub": node.name, "super": name})
        elif isinstance(node, ast.Import):
            out["imports"] += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            if node.module and not node.level:
                out["imports"].append(node.module)
        elif isinstance(node, ast.Call):
            name = callee(node.func)
            if name:
                out["calls"].append({"callee": name, "line": node.lineno})
    out["symbols"].sort(key=lambda x: (x["start_line"], x["name"]))
    out["calls"].sort(key=lambda x: x["line"])
    return out


def _python_words(text: str, want: Collection[str] = KINDS) -> dict:
    """What can be told of Python that does not parse: definitions by indentation, and calls."""
    s = Source("python", text)
    f = Facts(s, want)
    lines = text.split("\n")
    for k, x in enumerate(s.texts):
        if x in ("def", "class") and s.is_word(k + 1):
            f.symbol("class" if x == "class" else "function", k + 1, k, k + 1)
            if "symbols" not in want:
                continue
            line = s.line(k)
            depth = len(lines[line - 1]) - len(lines[line - 1].lstrip())
            end = line
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > depth):
                end += 1
            f.out["symbols"][-1] |= {"end_line": end, "signature": _signature(lines[line - 1])}
        elif x == "import" and s.is_word(k + 1):
            f.out["imports"].append(s.at(k + 1))
    f.calls()
    f.out["had_parse_error"] = True
    return f.out


LANGUAGES = {"java": _java_like, "csharp": _java_like, "typescript": _typescript, "javascript": _typescript, "rust": _rust}


def extract(lang: str, path: str, text: str, want: Collection[str] = KINDS, source: Source | None = None) -> dict:
    """The facts of one file, of the kinds in ``want``; languages without a parser have none. ``source`` is the text's, if it is known."""
    if lang == "python":
        return _python(text, want)
    return LANGUAGES[lang](source or Source(lang, text), want) if lang in LANGUAGES else empty()


def extract_files(files: DataFrame, rules: dict | None = None, want: Collection[str] | None = None) -> DataFrame:
    """``files`` (repo, path, lang, text) with their facts and framework facts as nested columns: one narrow pass, a file at a time.

    ``want`` names the kinds that are needed, of KINDS and of the framework's; others need not be looked for: their columns are empty.
    """
    schema = f"repo string, path string, lang string, {FACTS}, framework string"
    kinds = set(KINDS if want is None else want).intersection(KINDS)
    web_kinds = set(FRAMEWORK_KINDS if want is None else want).intersection(FRAMEWORK_KINDS)

    def facts_of(lang: str | None, path: str, text: str) -> tuple[dict, str | None]:
        web = lang in PARSED and has_framework_facts(lang, rules, web_kinds)
        source = Source(lang, text) if web or kinds and lang in LANGUAGES else None
        found = extract(lang or "", path, text, kinds, source) if kinds else empty()
        return found, json.dumps(framework_facts(lang, text, rules, web_kinds, source) if web else no_framework_facts()) if lang in PARSED else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                repo, path, lang, text = part.columns
                rows = [facts_of(lang, path, text or "") for lang, path, text in zip(lang.to_pylist(), path.to_pylist(), text.to_pylist(), strict=True)]
                facts = [_column([f[name] for f, _ in rows], kind) for name, kind in zip(ARROW.names[3:-1], ARROW.types[3:-1], strict=True)]
                yield pa.RecordBatch.from_arrays([*(x.cast(_TEXT) for x in (repo, path, lang)), *facts, pa.array([w for _, w in rows], _TEXT)], schema=ARROW)

    return files.select("repo", "path", "lang", "text").mapInArrow(run, schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow array; lists are laid end to end and structs taken apart, which is faster than row by row."""
    if pa.types.is_list(kind):
        ends = accumulate(map(len, values), initial=0)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column([x for v in values for x in v], kind.value_type), type=kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_column([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    return pa.array(values, kind)


#: Files whose facts are in Python's memory at once.
SLICE = 1000
_TEXT = pa.string()
ARROW = pa.schema([
    ("repo", _TEXT), ("path", _TEXT), ("lang", _TEXT),
    ("symbols", pa.list_(pa.struct([("name", _TEXT), ("kind", _TEXT), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", _TEXT), ("doc", _TEXT), ("partial", pa.bool_())]))),
    ("imports", pa.list_(_TEXT)), ("calls", pa.list_(pa.struct([("callee", _TEXT), ("line", pa.int32())]))),
    ("supertypes", pa.list_(pa.struct([("sub", _TEXT), ("super", _TEXT)]))), ("had_parse_error", pa.bool_()), ("framework", _TEXT),
])

