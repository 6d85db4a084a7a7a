"""A tolerant lexer for brace languages and Python: words, strings, punctuation and comments with their lines, and which brackets pair."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_COMMON = r"(?P<word>[^\W\d][\w$]*|\$[\w$]*|@[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<op>=>|->|::|\?\.|\.\.\.|[-+*/%&|^!=<>]=|&&|\|\||[^\s\w])"
_C_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_DOUBLE = r"\"(?:\\.|[^\"\\\n])*\"?"
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_PATTERNS = {
    "java": rf"{_C_COMMENT}|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|{_DOUBLE}|{_SINGLE})|{_COMMON}",
    "csharp": rf"{_C_COMMENT}|(?P<string>\$?@\$?\"(?:\"\"|[^\"])*\"?|\$?{_DOUBLE}|{_SINGLE})|{_COMMON}",
    "typescript": rf"{_C_COMMENT}|(?P<string>`(?:\\.|[^`\\])*`?|{_DOUBLE}|{_SINGLE})|{_COMMON}",
    "rust": rf"{_C_COMMENT}|(?P<string>b?r#*\".*?\"#*|b?{_DOUBLE}|'(?:\\.|[^'\\\n])')|{_COMMON}",
    "python": rf"(?P<comment>\#[^\n]*)|(?P<string>[fFrRbBuU]{{0,2}}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|{_DOUBLE}|{_SINGLE}))|{_COMMON}",
}
_PATTERNS["javascript"] = _PATTERNS["typescript"]
LEXERS = {k: re.compile(v, re.S) for k, v in _PATTERNS.items()}
OPEN, CLOSE = "([{", {")": "(", "]": "[", "}": "{"}


class Source:
    """Tokens without comments (texts, kinds and starts by their places), where the comments stand, and the partner of every bracket."""

    def __init__(self, lang: str, text: str):
        self.lang, self.text = lang, text
        self.texts: list[str] = []
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.comments: list[tuple[int, str]] = []
        self.pair: dict[int, int] = {}
        self.broken = False
        add_text, add_kind, add_start = self.texts.append, self.kinds.append, self.starts.append
        stack: list[int] = []
        for m in LEXERS[lang].finditer(text):
            kind, x = m.lastgroup or "op", m.group()
            if kind == "comment":
                self.comments.append((m.start(), x))
                continue
            if kind == "op":
                if x in OPEN:
                    stack.append(len(self.texts))
                elif x in CLOSE:
                    if stack and self.texts[stack[-1]] == CLOSE[x]:
                        k = len(self.texts)
                        self.pair[k] = stack[-1]
                        self.pair[stack.pop()] = k
                    else:
                        self.broken = True
            add_text(x)
            add_kind(kind)
            add_start(m.start())
        self.n = len(self.texts)
        self.broken |= bool(stack)
        self._ends: list[int] | None = None
        self._lines: list[int] | None = None

    def at(self, k: int) -> str:
        return self.texts[k] if 0 <= k < self.n else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < self.n and self.kinds[k] == "word"

    def end(self, k: int) -> int:
        return self.starts[k] + len(self.texts[k])

    def line(self, k: int) -> int:
        if self._lines is None:
            self._lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        return bisect_right(self._lines, self.starts[k])

    def called(self) -> Iterator[tuple[int, int]]:
        """Words before a parenthesis, type arguments between them passed over: (place, place of the parenthesis)."""
        texts, kinds = self.texts, self.kinds
        for k in range(1, self.n):
            if texts[k] == "(" and kinds[k - 1] == "word":
                yield k - 1, k
            elif texts[k] == "<" and kinds[k - 1] == "word":
                n = self.skip_angles(k)
                if self.at(n) == "(":
                    yield k - 1, n

    def after(self, k: int) -> int:
        """The place after the group that opens at k."""
        return self.pair.get(k, self.n - 1) + 1

    def skip_angles(self, k: int) -> int:
        """The place after type arguments at k, or k."""
        if self.at(k) != "<":
            return k
        depth = 0
        for j in range(k, min(k + 200, self.n)):
            x = self.texts[j]
            depth += (x == "<") - (x == ">")
            if depth <= 0:
                return j + 1
            if x in (";", "{", "}"):
                break
        return k

    def doc_before(self, k: int) -> str | None:
        """The comment that stands directly before token k, up to 500 characters."""
        limit = self.starts[k]
        if self._ends is None:
            self._ends = [a + len(x) for a, x in self.comments]
        j = bisect_right(self._ends, limit) - 1
        if j < 0 or self.text[self._ends[j] : limit].strip():
            return None
        i = j
        while i and self.comments[i][1].startswith(("//", "#")) and self.comments[i - 1][1][:2] == self.comments[i][1][:2] and not self.text[self._ends[i - 1] : self.comments[i][0]].strip():
            i -= 1
        return self.text[self.comments[i][0] : self._ends[j]][:500]

    def arguments(self, k: int) -> list[tuple[int, int]]:
        """Token ranges of the arguments of the group that opens at k."""
        end = self.pair.get(k, self.n)
        out, start, j = [], k + 1, k + 1
        while j < end:
            if self.at(j) in ("(", "[", "{"):
                j = self.after(j)
                continue
            if self.at(j) == ",":
                out.append((start, j))
                start = j + 1
            j += 1
        if start < end:
            out.append((start, end))
        return out
