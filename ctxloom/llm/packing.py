"""Best-fit packing of tokenised documents: hierarchical residual packing.

Each task cuts its documents into pieces and packs them best-fit decreasing. Bins that are nearly full are
final; the underfull ones become items of the next round, in which fewer tasks merge them, until one task is left.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.shared import Scratch
from ctxloom.llm.tokens import ByteTokenizer

PIECE = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>"
ITEMS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))
#: Underfull bins that a merging task holds at most, about.
MOST_BINS = 200_000
BIN = f"size long, closed boolean, items array<{PIECE}>"


class BestFit:
    """Bins by what is left in them; a bit set gives the fullest bin that still takes an item."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.by_left, self.open = capacity, [], {}, 0

    def add(self, size: int, item: object) -> None:
        fits = self.open >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            stack = self.by_left[left]
            k = stack.pop()
            if not stack:
                self.open &= ~(1 << left)
            self.bins[k][1].append(item)
            self.bins[k][0] += size
            left -= size
        else:
            k, left = len(self.bins), self.capacity - size
            self.bins.append([size, [item]])
        if left:
            self.by_left.setdefault(left, []).append(k)
            self.open |= 1 << left


def best_fit(items: list[tuple[int, object]], capacity: int) -> list[tuple[int, list]]:
    """Bins (size, items) of the best-fit decreasing heuristic; equal sizes keep their order."""
    fit = BestFit(capacity)
    for size, item in sorted(items, key=lambda x: -x[0]):
        fit.add(size, item)
    return [(size, of) for size, of in fit.bins]


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece of a long one may be short."""
    n, start, piece = len(ids), 0, 0
    raw = ids.astype("<u4").tobytes()
    while start < n:
        length = (n % capacity or capacity) if not start else capacity
        yield piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])
        start, piece = start + length, piece + 1


def _emit(bins: list[tuple[int, list]], capacity: int, slack: int, last: bool) -> pa.RecordBatch:
    placed = []
    for _, items in bins:
        at, row = 0, []
        for x in items:
            row.append((*x[:5], at))
            at += x[3]
        placed.append(row)
    columns = [pa.array([b[0] for b in bins], pa.int64()), pa.array([last or b[0] >= capacity - slack for b in bins], pa.bool_()), pa.array(placed, ITEMS)]
    return pa.RecordBatch.from_arrays(columns, ["size", "closed", "items"])


def _spare(sizes: list[int], closed: list[bool], most: int, seen: Counter) -> list[bool]:
    """``closed``, and true for all bins beyond the first ``most`` of their size; ``seen`` counts the bins of each."""
    out = []
    for size, c in zip(sizes, closed, strict=True):
        seen[size] += 1
        out.append(c or seen[size] > most)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, slack: int = 8, fan_in: int = 8, end_id: int = 0) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    A document is the ids of its whole text under the tokenizer file ``tokenizer`` and then ``end_id``; null is the
    empty text. Returns one row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    sequence_length. Sequences have no gaps. A bin with at most ``slack`` tokens free is final in the round that
    made it; each round has a ``fan_in``-th of the tasks of the one before. Rows that repeat are packed as often as
    they come, null doc_ids are kept, other columns are not read, an empty table gives no rows.
    A merging task leaves at most one bin that is half full or less (two would have been one). Any later merge uses up one of these, so after t tasks t bins of a size are all
    that can still be added to: each task closes what it has beyond that, and where too many are left for the next round, passes over fewer and fewer parts close the rest.
    A task holds the pieces of its own partition (five numbers each), never their texts or ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, fit = ByteTokenizer(tokenizer), []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(t.ids(text or ""), np.uint32(end_id))
                for piece, start, length, crc in cut(ids, capacity):
                    fit.append((length, (doc_id, piece, start, length, crc)))
            if len(fit) > 1 << 19:
                yield _emit(best_fit(fit, capacity), capacity, slack, False)
                fit = []
        if fit:
            yield _emit(best_fit(fit, capacity), capacity, slack, False)

    def merge(last: bool, tasks: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(s, i) for b in batches for s, i in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            bins = [(size, [tuple(x.values()) for part in parts for x in part]) for size, parts in best_fit(held, capacity)]
            seen = Counter()
            for k in range(0, len(bins), 4096):
                b = _emit(bins[k : k + 4096], capacity, slack, last)
                yield b.set_column(1, "closed", pa.array(_spare(b.column(0).to_pylist(), b.column(1).to_pylist(), tasks, seen), pa.bool_()))

        return run

    def thin(tasks: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = Counter()
            for b in batches:
                closed = _spare(b.column(0).to_pylist(), b.column(1).to_pylist(), tasks, seen)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(closed, pa.bool_()), b.column(2)], ["size", "closed", "items"])

        return run

    now = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, BIN), "round0")
    done, k = [now.where("closed")], 0
    tasks = max(1, now.rdd.getNumPartitions())
    left = now.where("not closed")
    most = max(MOST_BINS, 2 * capacity)  # one part leaves tasks bins of a size: half of the tasks hold them, so that the tasks come down to one
    while True:
        rows, parts = left.count(), tasks
        while k and parts > 1 and rows > most * -(-tasks // fan_in):
            parts = -(-parts // fan_in)
            dealt = left.repartition(parts, F.xxhash64("items"))
            now = scratch.keep(dealt.mapInArrow(thin(tasks), BIN), f"thin{k}-{parts}")
            done.append(now.where("closed"))
            left = now.where("not closed")
            rows = left.count()
        tasks = max(-(-tasks // fan_in), -(-rows // most))
        k += 1
        last = tasks == 1
        merged = left.repartition(tasks, F.xxhash64("items")) if tasks > 1 else left.coalesce(1)
        now = scratch.keep(merged.mapInArrow(merge(last, tasks), BIN), f"round{k}")
        done.append(now.where("closed"))
        if last:
            break
        left = now.where("not closed")
    bins = done[0]
    for b in done[1:]:
        bins = bins.unionByName(b)
    bins = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "size", "items")
    return bins.select("sequence_id", F.col("size").alias("sequence_length"), F.explode("items").alias("x")).select("x.*", "sequence_id", "sequence_length")
