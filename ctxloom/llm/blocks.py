"""Blocks of documents that exchange sorted keys with buckets.

Counting n-grams or finding shared passages would shuffle a row for each position of the corpus. Instead the documents
are packed once into blocks of a few MB. Each block sends each bucket one compressed array with its
distinct keys (its own repeats are already merged), the bucket merges the arrays of all blocks, and sends back answers in
the order of the keys, so that they need no keys. Where data are so large that a block has less than one key for a
bucket, empty arrays are not sent, so the exchange never has more rows than keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.shared import Scratch

#: Text bytes in a block, and text bytes of the corpus for each bucket. Memory of a task follows these, not the input.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 6 << 20
NO_ID = np.int64(2**63 - 1)


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value; numbers are turned so that equal bytes of neighbours meet."""
    out = []
    for a in arrays:
        if isinstance(a, np.ndarray):
            kind, n = a.dtype.str.encode(), len(a)
            a = np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T.tobytes() if n else b""
        else:
            kind, n = b"raw", len(a)
        out.append(len(kind).to_bytes(1, "little") + kind + n.to_bytes(8, "little") + len(a).to_bytes(8, "little") + a)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unsqueeze(value: bytes) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(value), 0, []
    while at < len(raw):
        k = raw[at]
        kind = raw[at + 1 : at + 1 + k]
        at += 1 + k
        n, size = int.from_bytes(raw[at : at + 8], "little"), int.from_bytes(raw[at + 8 : at + 16], "little")
        part, at = raw[at + 16 : at + 16 + size], at + 16 + size
        if kind == b"raw":
            out.append(part)
        else:
            dtype = np.dtype(kind.decode())
            out.append(np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if n else np.empty(0, dtype))
    return out


class Block:
    """Documents of one block: ids (NO_ID for null), text (UTF-8, one after the other) and where each starts and ends."""

    def __init__(self, value: bytes):
        self.ids, lengths, text = unsqueeze(value)
        self.text = np.frombuffer(text, np.uint8)
        self.stops = np.cumsum(lengths)
        self.starts = self.stops - lengths

    def texts(self) -> Iterator[bytes]:
        raw = self.text.tobytes()
        return (raw[a:b] for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True))


def pack_blocks(docs: DataFrame, scratch: Scratch, role: Column | None = None) -> DataFrame:
    """(block, role, n_docs, n_bytes, value) of ``docs`` (doc_id, text; null text: empty), written to ``scratch``.

    A block holds documents of one ``role`` (a small number, 0 if not given).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}
        size: dict[int, int] = {}

        def flush(of: int) -> pa.RecordBatch:
            nonlocal k
            ids, texts = held.pop(of)
            value = squeeze(np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64), b"".join(texts))
            k += 1
            row = [(task << 32) + k - 1], [of], [len(ids)], [size.pop(of)], [value]
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["block", "role", "n_docs", "n_bytes", "value"])

        for b in batches:
            for i, t, r in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                t = (t or "").encode("utf-8", "surrogatepass")
                ids, texts = held.setdefault(r, ([], []))
                ids.append(NO_ID if i is None else i)
                texts.append(t)
                size[r] = size.get(r, 0) + len(t)
                if size[r] >= BLOCK_BYTES or len(ids) >= BLOCK_BYTES // 64:
                    yield flush(r)
        for r in sorted(held):
            yield flush(r)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(0) if role is None else role).cast("int").alias("role"))
    return scratch.keep(rows.mapInArrow(run, "block long, role int, n_docs long, n_bytes long, value binary"), "blocks")


def bucket_count(blocks: DataFrame) -> int:
    return max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))


def each(rows: DataFrame, of: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """``of`` over each row; every tuple it yields becomes a row."""
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
                if got := list(of(row)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def by_bucket(rows: DataFrame, of: Callable[[list[tuple[int, bytes]]], list[tuple[int, bytes]]], buckets: int) -> DataFrame:
    """Rows (block, bucket, value) met by bucket: ``of`` gets [(block, value)] of one and gives the answers [(block, value)]."""

    def run(t: pa.Table) -> pa.Table:
        got = of(sorted(zip(t["block"].to_pylist(), t["value"].to_pylist(), strict=True)))
        return pa.table({"block": pa.array([g[0] for g in got], pa.int64()), "bucket": pa.array([t["bucket"][0].as_py()] * len(got), pa.int32()), "value": pa.array([g[1] for g in got], pa.binary())})

    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, "block long, bucket int, value binary")


def by_block(blocks: DataFrame, answers: DataFrame, of: Callable[[Block, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Each block with its answers by bucket. A block's text and answers are a few MB."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right["bucket"].to_pylist(), right["value"].to_pylist(), strict=True))
        return of(Block(left["value"][0].as_py()), got)

    return blocks.select("block", "value").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def split_by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin and end: sorted unsigned 64-bit keys are dealt by their size."""
    if buckets == 1:
        return np.array([0, len(keys)])
    edges = (np.arange(1, buckets, dtype=object) * (2**64 // buckets)).astype(np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]
