"""Toxicity by maximum-scoring segments.

Token scores are log-odds of toxic against clean labelled documents under an informative Dirichlet prior, less a small drift, so that
a clean text scores below zero on average. A linear scan gives all maximal-scoring segments of a text. Extreme-value theory says how often a
clean text of that length holds segments as good, and the segments of a document together give its score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.llm.anchors import MIX
from ctxloom.llm.shared import Scratch, remainder

#: ASCII upper case to lower, ASCII punctuation and blanks to spaces; other bytes stay.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32) for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Lengths of stems, in bytes.
STEMS = (6, 5, 4)
GAMMA = 0.5772156649015329


class _Scores(dict):
    """Scores of words: a word's own, or else that of its longest stem that has one. It forgets when it gets large."""

    def __init__(self, odds: dict[bytes, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> float | None:
        if len(self) > 200_000:
            self.clear()
        found = next((s for f in features(word) if (s := self.odds.get(f)) is not None), None)
        self[word] = found
        return found


def features(word: bytes) -> list[bytes]:
    """What a word can be scored by: itself, then its stems from the longest on (marked by a space, which words do not hold)."""
    return [word, *(word[:k] + b" " for k in STEMS if len(word) > k)]


@dataclass
class Model:
    """Scores of the tokens that tell the classes apart, what any other token costs, and the calibration."""

    odds: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.1
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    base: float = -2.0
    significance: float = 0.01

    @property
    def known(self) -> _Scores:
        if "_known" not in self.__dict__:
            self._known = _Scores(self.odds)
        return self._known

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Every maximal-scoring segment (start, stop, score), by a scan that touches each token once."""
        known = self.known
        hits = [(i, s) for i, w in enumerate(words) if (s := known[w]) is not None]
        stack: list[list] = []  # [start, stop, total before it, total with it]
        total, at = 0.0, 0
        for i, s in hits:
            total -= self.drift * (i - at)
            at = i + 1
            before, total = total, total + s - self.drift
            if total <= before:
                continue
            here = [i, i + 1, before, total]
            while True:
                k = len(stack) - 1
                while k >= 0 and stack[k][2] >= here[2]:
                    k -= 1
                if k < 0 or stack[k][3] >= here[3]:
                    stack.append(here)
                    break
                here = [stack[k][0], here[1], stack[k][2], here[3]]
                del stack[k:]
        return [(a, b, r - left) for a, b, left, r in stack]

    def surprise(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """-log10 of the chance that a clean text of n tokens has segments as good: the best of the sum statistics of the r best."""
        if not segments:
            return 0.0
        best, total = 0.0, 0.0
        shift = self.log_k + math.log(max(n, 1))
        for r, s in enumerate(sorted((x[2] for x in segments), reverse=True), 1):
            x = self.decay * s - shift
            if r > 1 and x <= 0:
                break
            total += x
            if r == 1:
                log_p = math.log(-math.expm1(-math.exp(-total))) if total < 30 else -total
            elif total > 0:
                log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            else:
                continue
            best = max(best, -min(0.0, log_p) / math.log(10))
        return best

    def probability(self, surprise: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.base + self.slope * math.log1p(surprise)))))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, ASCII in lower case; any character beyond ASCII counts as a letter."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z) of each token's rate in the two classes under a Dirichlet prior: half a count each, and ``prior`` counts in the corpus's proportions."""
    n1, n0 = toxic.sum(), clean.sum()
    alpha = prior * (toxic + clean) / max(n1 + n0, 1) + 0.5
    a, b = toxic + alpha, clean + alpha
    odds = np.log(a / np.maximum(n1 + prior - a, 1e-9)) - np.log(b / np.maximum(n0 + prior - b, 1e-9))
    return odds, odds / np.sqrt(1 / a + 1 / b)


def _decay(values: np.ndarray, n: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1, the rate at which good segments get rare in clean text."""
    p = n / n.sum()
    if (p * values).sum() >= 0 or values.max() <= 0:
        return 1.0
    low, high = 1e-9, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope >= 0) by Newton steps with a light ridge."""
    w = np.zeros(2)
    a = np.stack((np.ones(len(x)), x), axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _third(doc_id: int) -> int:
    """0 for the third of the labelled documents that calibrates."""
    return zlib.crc32(f"{doc_id} calibrates".encode()) % 3


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, most_labels: int = 20_000, prior: float = 500.0, least_z: float = 3.0, most_tokens: int = 50_000, drift: float = 0.1) -> Model:
    """A model from labelled documents: ``labels`` (doc_id, toxic) for which ``learn`` holds (crc32 of the id modulo 5 is not 0).

    At most ``most_labels`` labelled documents teach it, those whose id hashes lowest (of ids labelled twice the higher label counts); two thirds give the
    token counts and one third the calibration. Of near copies among them (equal least hash of the five-word shingles, under either of two hashes) one counts.
    Rows of ``docs`` that repeat (doc_id, text) count once; different texts of one doc_id each count, with its label.
    A token or stem counts once for each document. At most ``most_tokens`` tokens of ``least_z`` or more are kept. Both bounds keep
    what reaches the driver and the tasks of one size for any input; the texts of these labels are written once, the corpus is read once for them. Null labels and ids are left out; without labels of both kinds every
    text scores as clean.
    """
    learn = remainder("doc_id", 5) != 0 if learn is None else learn
    sample = labels.where("toxic is not null and doc_id is not null").where(learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = {r["doc_id"]: int(r["toxic"] > 0) for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()}
    model = Model(drift=drift)
    if len(set(known.values())) < 2:
        return model
    ids = docs.sparkSession.createDataFrame([(i,) for i in known], "known long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("known"), "left_semi").distinct()
    texts = Scratch(docs.sparkSession, "toxicity").keep(texts, "labelled")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i in known:
                    w = words_of(t)
                    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))), np.uint64)
                    rows.append((i, *(int((h * m >> np.uint64(1)).min()) for m in MIX[:2])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["doc_id", "a", "b"])

    first: dict[tuple[str, int], int] = {}
    for r in sorted(texts.mapInArrow(sketch, "doc_id long, a long, b long").collect()):
        holders = [first.setdefault(("a", r["a"]), r["doc_id"]), first.setdefault(("b", r["b"]), r["doc_id"])]
        if any(h != r["doc_id"] for h in holders):
            known.pop(r["doc_id"], None)
    if len(set(known.values())) < 2:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i in known and _third(i):
                    seen[known[i]].update({f for w in set(words_of(t)) for f in features(w)})
        words = [*(seen[0] | seen[1])]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    counts = texts.mapInArrow(count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
    n1, n0 = (int(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n1 or not n0:
        return model
    # Only tokens of some evidence come to the driver; the prior's share is the corpus's own proportion.
    some = counts.where("toxic + clean >= 3").withColumn("gap", F.abs(F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(F.col("toxic") + F.col("clean"))).orderBy(F.desc("gap"), "word").limit(most_tokens).collect()
    counts.unpersist()
    y1, y0 = np.array([r["toxic"] for r in some], float), np.array([r["clean"] for r in some], float)
    rest1, rest0 = n1 - y1.sum(), n0 - y0.sum()
    odds, z = (v[:-1] for v in log_odds(np.append(y1, rest1), np.append(y0, rest0), prior))
    keep = np.abs(z) >= least_z
    model.odds = {bytes(r["word"]): float(o) for r, o, k in zip(some, odds, keep, strict=True) if k}
    clean = y0[keep] + 0.5
    model.decay = _decay(np.append(odds[keep], 0.0) - drift, np.append(clean, max(n0 - clean.sum(), 1)))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i in known and not _third(i) and not known[i]]
            found = [(max(s[2] for s in got), len(w)) for w in words if (got := model.segments(w))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.float64()), pa.array([r[1] for r in found], pa.int64())], ["best", "n"])

    tops = [model.decay * r["best"] - math.log(max(r["n"], 1)) for r in texts.mapInArrow(top, "best double, n long").collect()]
    model.log_k = float(np.mean(tops)) - GAMMA if tops else 0.0

    def surprises(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(known[i], words_of(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i in known and not _third(i)]
            found = [math.log1p(model.surprise(model.segments(w), len(w))) for _, w in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(found, pa.float64())], ["toxic", "surprise"])

    rows = sorted(texts.mapInArrow(surprises, "toxic int, surprise double").collect())
    x = np.array([r["surprise"] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    if len(rows) and 0 < y.sum() < len(y):
        model.base, model.slope = _logistic(x, y)
    return model


PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity", passages: str | None = None) -> DataFrame:
    """``docs`` with one more column ``into``, the probability that the whole text is toxic, for every row.

    ``passages`` names a further column with the significant segments: where they start and stop in the text's UTF-8 bytes, their score, and how many as good a clean
    text of the length holds on average. A null text counts as the empty text, which has no segment. Rows pass through one by one in their order,
    with all their columns; new names must not be among them.
    """
    if {into, passages} & set(docs.columns):
        raise ValueError(f"{into} or {passages} is a column already")
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType()), *([T.StructField(passages, PASSAGE)] if passages else [])])
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, found = [], []
            for t in b.column(at).to_pylist():
                words = words_of(t)
                segments = model.segments(words)
                scores.append(model.probability(model.surprise(segments, len(words))))
                if passages:
                    odd = [(s, model.log_k + math.log(len(words)) - model.decay * s[2]) for s in segments]
                    odd = [(s, math.exp(min(e, 700))) for s, e in odd if e < math.log(model.significance)]
                    places = [m.span() for m in _WORD.finditer(t.encode("utf-8", "surrogatepass").translate(_LETTERS))] if odd else []
                    found.append([{"start": places[s[0]][0], "stop": places[s[1] - 1][1], "score": s[2], "e_value": e} for s, e in odd])
            columns = [*b.columns, pa.array(scores, pa.float64()), *([pa.array(found, kind)] if passages else [])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
