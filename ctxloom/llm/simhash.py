"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into ``segments``. Two fingerprints within ``distance`` bits agree in at least one
segment up to ``distance // segments`` bits, so every fingerprint is entered in one table for each segment
and each of its small Hamming balls is looked up there. Candidates are then held to the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.components import connected_components
from ctxloom.llm.shared import Scratch, parallelism

BITS = 64
#: A bucket with more rows than this is cut into blocks, and each pair of blocks becomes a bucket of its own.
BLOCK = 8192


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of a text: bit i is set if over half of its shingles' XXH64 (seed 42) have it; no word gives 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = (ends - np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1).tolist()
    n = max(1, len(tokens) - words + 1)
    stops = (ends - 1).tolist()[min(words, len(tokens)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n], stops, strict=True)), np.uint64, n)
    total = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        total += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp: long) for every row of ``docs`` (doc_id, text); fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _entries(segment: int, at: int, width: int, radius: int) -> Column:
    value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))

    def row(key: Column, own: bool) -> Column:
        return F.struct(F.lit(segment).alias("segment"), key.alias("key"), F.lit(own).alias("own"))

    if not radius:
        return F.array(row(value, True))
    clear = F.filter(F.array(*(F.lit(1 << b).cast("long") for b in range(width))), lambda m: value.bitwiseAND(m) == 0)
    return F.concat(F.array(row(value, True)), F.transform(clear, lambda m: row(value.bitwiseOR(m), False)))


def _lookups(fps: DataFrame, segments: int, radius: int) -> DataFrame:
    """Rows (segment, key, own, fp, rep): a fingerprint's table entries and, for radius 1, its ball.

    Of two segments that differ in one bit exactly one has it clear, so it suffices to look up the keys that
    set one clear bit: half the ball finds every pair once.
    """
    if radius > 1:
        raise ValueError("balls of radius 0 and 1 are enumerated; use more segments")
    rows = [_entries(s, at, width, radius) for s, (at, width) in enumerate(_bounds(segments))]
    return fps.select("fp", "rep", F.explode(F.concat(*rows)).alias("e")).select("e.segment", "e.key", "e.own", "fp", "rep")


def _blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds (part): 0 for buckets of at most BLOCK rows; the larger are cut into blocks, of which every pair is a bucket.

    Nothing is dropped: each two rows of a bucket share at least one of its parts.
    """
    big = scratch.keep(rows.groupBy("segment", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "big")
    if big.isEmpty():
        return rows.withColumn("part", F.lit(0))
    cut = rows.join(big, ["segment", "key"], "left").withColumn("of", F.ceil(F.coalesce("n", F.lit(0)) / (BLOCK // 2)).cast("int"))
    mine = F.pmod(F.xxhash64("fp", "rep"), F.greatest("of", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda o: F.least(o, F.col("mine")) * F.col("of") + F.greatest(o, F.col("mine")))
    return cut.withColumn("mine", mine).select("segment", "key", "own", "fp", "rep", F.explode(F.when(F.col("of") > 1, pairs).otherwise(F.array(F.lit(0)))).alias("part"))


def _links(own: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of one bucket's links; every table entry meets every row of the bucket."""
    found, root = [], {}

    def top(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = root.get(p, p)
            x = p
        return x

    for i in np.flatnonzero(own):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= distance):
            a, b = top(int(rep[i])), top(int(rep[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(rep[i]), int(rep[j])))
    return found


def links(fps: DataFrame, distance: int, segments: int, scratch: Scratch) -> DataFrame:
    """(src, dst) of distinct fingerprints (fp, rep) within ``distance`` bits: enough links to connect every pair that is.

    Each bucket gives a forest of its verified links, at most one fewer than it has fingerprints.
    """
    rows = _blocks(_lookups(fps, segments, distance // segments), scratch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None

        def settle(b: pd.DataFrame) -> pd.DataFrame:
            own, fp, rep = b["own"].to_numpy(bool), b["fp"].to_numpy(np.int64).view(np.uint64), b["rep"].to_numpy(np.int64)
            k = b[["segment", "key", "part"]].to_numpy(np.int64)
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
            size = np.diff(np.r_[first, len(b)])
            out = []
            useful = (size > 1) & (np.add.reduceat(own, first) > 0)
            small = useful & (size <= 64)
            # Small buckets together: each table entry beside every row of its bucket.
            bucket = np.repeat(np.arange(len(first)), size)
            i = np.flatnonzero(own & small[bucket])
            n = size[bucket[i]]
            a = np.repeat(i, n)
            c = np.repeat(first[bucket[i]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            near = (a != c) & (np.bitwise_count(fp[a] ^ fp[c]) <= distance)
            out.append(np.column_stack((rep[a[near]], rep[c[near]])))
            for s, n in zip(first[useful & ~small], size[useful & ~small], strict=True):
                if got := _links(own[s : s + n], fp[s : s + n], rep[s : s + n], distance):
                    out.append(np.array(got, np.int64))
            got = np.concatenate(out)
            got = np.unique(np.column_stack((got.max(axis=1), got.min(axis=1))), axis=0) if len(got) else got.reshape(0, 2)
            return pd.DataFrame({"src": got[:, 0], "dst": got[:, 1]})

        for b in batches:
            if left is not None:
                b = pd.concat([left, b], ignore_index=True)
            k = b[["segment", "key", "part"]].to_numpy(np.int64)
            cut = int(np.flatnonzero((k != k[-1]).any(axis=1))[-1]) + 1 if (k != k[-1]).any() else 0
            left = b.iloc[cut:].reset_index(drop=True)
            if cut:
                yield settle(b.iloc[:cut])
        if left is not None and len(left):
            yield settle(left)

    keys = ["segment", "key", "part"]
    dealt = rows.repartition(parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, "src long, dst long").where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (signed long) and component_id.

    Texts are taken whole: ASCII letters in lower case, words between ASCII white space, shingles of ``words``
    words with repeats (a shorter text is one shingle). A text that is null, empty or blank has fingerprint 0
    and links like any other. Fingerprints within ``distance`` bits link; component_id is the smallest doc_id that links reach.
    Equal fingerprints are looked up once, whatever the number of their documents. Repeated rows come back as
    often as they came, rows with a null doc_id keep it and take the component of their fingerprint, further
    columns of ``docs`` are not read, an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, words), "fps")
    reps = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = links(reps.where("rep is not null"), distance, segments, scratch)
    parts = connected_components(found, scratch)
    of = scratch.keep(reps.join(parts, reps["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "of")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")
