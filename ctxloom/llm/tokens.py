"""A byte-level BPE read from a tokenizers file, and token counts that follow edits."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: How byte-level BPE cuts a text before merging (the GPT-2 rule, a fixed value of the format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts within these characters mean the same to both engines' Unicode tables; others go to tokenizers itself.
PLAIN = regex.compile("[\t\n\r -~¡-ɏ‐-…]*")


def _byte_letters() -> dict[str, int]:
    """The format's letters for bytes: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """The ids that the tokenizers library gives with add_special_tokens=False.

    Plain texts are encoded by tiktoken over the same vocabulary, in a third of the time; the two are compared in the tests.
    Texts with other characters, and any text on which that engine gives up, go through tokenizers.
    """

    def __init__(self, path: str):
        self.engine, self.fast = _load(path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and PLAIN.fullmatch(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # its native panics aren't Exceptions
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
        return np.array(self.engine.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def _load(path: str) -> tuple[Tokenizer, tiktoken.Encoding | None]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    engine, fast = Tokenizer.from_file(path), None
    if spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space"):
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in special}
        fast = tiktoken.Encoding("from-file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)
    return engine, fast


class TokenTree:
    """Token counts of one text that follow its edits.

    The text's pre-tokens are leaves, in chunks; above the chunks a binary tree keeps the characters and tokens of each subtree.
    An edit cuts anew from a few pre-tokens before it until the cuts meet old ones; only these pre-tokens are encoded, and only
    the sums above their chunks change. Special tokens' strings are ordinary text here.
    """

    CHUNK = 64
    #: Pre-tokens before an edit that are cut again. How a pre-token ends depends on no more than the rest of a run of white space or two characters.
    CONTEXT = 3

    def __init__(self, text: str, count: PieceCounts):
        self.text, self.count, self.encoded = text, count, 0
        pieces = count.pattern.findall(text)
        self.chunks = [pieces[k : k + self.CHUNK] for k in range(0, len(pieces), self.CHUNK)] or [[]]
        self.leaves = 1 << (len(self.chunks) - 1).bit_length()
        self.chars = [0] * (2 * self.leaves)
        self.tokens = [0] * (2 * self.leaves)
        get = count.of
        for k, chunk in enumerate(self.chunks):
            self.chars[self.leaves + k] = sum(map(len, chunk))
            self.tokens[self.leaves + k] = sum(map(get, chunk))
        for k in range(self.leaves - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(map(len, self.chunks))

    def _find(self, at: int) -> tuple[int, int, int]:
        """(chunk, place in it, where it starts) of the pre-token that holds character ``at``; the end of the text is in the last."""
        k, start = 1, 0
        while k < self.leaves:
            k *= 2
            if start + self.chars[k] <= at and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        chunk = min(k - self.leaves, len(self.chunks) - 1)
        pieces = self.chunks[chunk]
        for j, p in enumerate(pieces):
            if at < start + len(p):
                return chunk, j, start
            start += len(p)
        return chunk, len(pieces), start

    def _step(self, chunk: int, j: int, start: int, back: bool) -> tuple[int, int, int] | None:
        if back:
            while not j:
                if not chunk:
                    return None
                chunk -= 1
                j = len(self.chunks[chunk])
            return chunk, j - 1, start - len(self.chunks[chunk][j - 1])
        start += len(self.chunks[chunk][j])
        j += 1
        while j == len(self.chunks[chunk]) and chunk + 1 < len(self.chunks):
            chunk, j = chunk + 1, 0
        return chunk, j, start

    def edit(self, start: int, stop: int, replacement: str) -> int:
        """Puts ``replacement`` in place of characters start to stop (cut to the text); returns how many pre-tokens were encoded anew."""
        n = len(self.text)
        start = max(0, min(start, n))
        stop = max(start, min(stop, n))
        q = start
        while q and self.text[q - 1].isspace():
            q -= 1
        first = self._find(max(q - 1, 0))
        for _ in range(self.CONTEXT):
            first = self._step(*first, True) or first
        self.text = self.text[:start] + replacement + self.text[stop:]
        moved = len(replacement) - (stop - start)
        # Old cuts from the edit's end on; new pre-tokens until one ends where an old one does.
        last, at, fresh = first, first[2], []
        match = self.count.pattern.match
        while at < len(self.text):
            m = match(self.text, at)
            fresh.append(m.group())
            at = m.end()
            if at - moved >= stop:
                while last[2] < at - moved and last[1] < len(self.chunks[last[0]]):
                    last = self._step(*last, False)
                if last[2] == at - moved and at >= start + len(replacement):
                    break
        else:
            last = (len(self.chunks) - 1, len(self.chunks[-1]), n)
        (a, i, _), (b, j, _) = first, last
        if a == b:
            self.chunks[a][i:j] = fresh
        else:
            self.chunks[a][i:] = fresh
            for k in range(a + 1, b):
                self.chunks[k] = []
            self.chunks[b][:j] = []
        for k in range(a, b + 1):
            at = self.leaves + k
            self.chars[at] = sum(map(len, self.chunks[k]))
            self.tokens[at] = sum(map(self.count.of, self.chunks[k]))
            while at > 1:
                at //= 2
                self._add(at)
        self.encoded += len(fresh)
        return len(fresh)


class PieceCounts:
    """Tokens of a pre-token, remembered for the most recent vocabulary of a task."""

    MOST = 400_000

    def __init__(self, path: str):
        engine, fast = _load(path)
        if fast is None:
            raise ValueError("a byte-level BPE file is needed")
        self.pattern, self.fast, self.known = regex.compile(PRE_TOKEN), fast, {}

    def of(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.fast._encode_single_piece(piece))
            if len(self.known) >= self.MOST:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n


def count_edits(docs: DataFrame, tokenizer: str, edits: Column) -> DataFrame:
    """Token counts of every row of ``docs`` (doc_id, text) before and after its edits.

    ``edits`` is an array of struct<start: long, stop: long, replacement: string> in characters, made one after the other, each on the text that
    the ones before left. Returns doc_id, n_tokens, n_pieces, edited_tokens, n_encoded (pre-tokens encoded for the edits) and edited_text. A null text is the
    empty text, null edits are none, places beyond the text are its end, a null replacement is empty. Rows come back one by one; other columns are not
    read; an empty table gives no rows.
    """
    kind = "doc_id long, n_tokens long, n_pieces long, edited_tokens long, n_encoded long, edited_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PieceCounts(tokenizer)
        for b in batches:
            rows = []
            for text, todo in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                tree = TokenTree(text or "", count)
                before, pieces = tree.n_tokens, tree.n_pieces
                for e in todo or []:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                rows.append((before, pieces, tree.n_tokens, tree.encoded, tree.text))
            cols = [b.column(0), *(pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(5))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_pieces", "edited_tokens", "n_encoded", "edited_text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", edits.alias("edits")).mapInArrow(run, kind)
