"""Suffix-array removal of passages that an earlier document holds.

Only suffixes that can matter are sorted. Anchors (chosen by content, about one in 16 bytes) lie in every window of
``window`` bytes; equal windows have equal anchors at equal places. Anchors whose gram is in one document only drop out. For the
others a bucket sorts the suffixes that start at the anchors, and the reversed prefixes that end there, by
deep-shallow sorting. Two windows that hold the anchor at the same offset are equal exactly if their right parts share a
range of the first suffix array and their left parts one of the second, so results do not hang on hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.anchors import anchors
from ctxloom.llm.blocks import NO_ID, Block, bucket_count, by_block, by_bucket, each, pack_blocks, split_by_bucket, squeeze, unsqueeze
from ctxloom.llm.shared import Scratch
from ctxloom.llm.suffixes import deep_shallow_sort

GRAM = 20
TRIM = np.uint64(12)


def _anchors(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, document's place) of a block's anchors."""
    at, g = anchors(block.text, block.starts, window, GRAM)
    return at, g, np.searchsorted(block.stops, at, side="right")


def _distinct(g: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and whether two documents of the block have each."""
    order = np.lexsort((ids, g))
    g, ids = g[order], ids[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    many = np.add.reduceat(np.r_[False, (g[1:] == g[:-1]) & (ids[1:] != ids[:-1])], first) > 0 if len(g) else np.empty(0, bool)
    return g[first], many


def _contexts(block: Block, at: np.ndarray, of: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes before each anchor (reversed) and from it on, zero beyond the document, with both lengths after them."""
    text = np.concatenate((np.zeros(left, np.uint8), block.text, np.zeros(right, np.uint8)))
    both = np.lib.stride_tricks.sliding_window_view(text, left + right)[at]
    before, after = np.minimum(at - block.starts[of], left), np.minimum(block.stops[of] - at, right)
    both = np.concatenate((both[:, :left][:, ::-1], both[:, left:]), axis=1)
    both[:, :left][np.arange(left) >= before[:, None]] = 0
    both[:, left:][np.arange(right) >= after[:, None]] = 0
    return both, before.astype(np.uint8), after.astype(np.uint8)


def _classes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """A number for each suffix; suffixes with the same ``depth`` first bytes have the same."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def covered_offsets(both: np.ndarray, before: np.ndarray, after: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each context a bit mask of the offsets at which a window around its anchor is also in a smaller document.

    ``least`` is the smallest document with the context. Bit o stands for the window that begins o bytes before the anchor.
    """
    left, n = window - GRAM, len(least)
    to_right = deep_shallow_sort(np.ascontiguousarray(both[:, left:]), after)
    to_left = deep_shallow_sort(np.ascontiguousarray(both[:, :left]), before)
    mask = np.zeros(n, np.int64)
    for o in range(left + 1):
        fits = np.flatnonzero((before >= o) & (after >= window - o))
        if len(fits) < 2:
            continue
        key = _classes(*to_right, window - o)[fits] * (n + 1) + (_classes(*to_left, o)[fits] if o else 0)
        order = np.argsort(key, kind="stable")
        key, rows = key[order], fits[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        smallest = np.repeat(np.minimum.reduceat(least[rows], first), size)
        mask[rows[smallest < least[rows]]] |= 1 << o
    return mask


def repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with what earlier documents already hold.

    Returns doc_id, n_bytes, spans (array of start and stop: maximal runs of bytes covered by a string of ``window`` bytes
    that also starts in a document with a smaller doc_id) and kept (the other bytes, binary). Texts are whole UTF-8 texts, null is
    the empty text. All is judged on the input: a removed byte still counts for later documents, matches do not cross documents. Rows
    with the same doc_id are not smaller than each other; a null doc_id is larger than all. Shorter texts than ``window`` lose nothing.
    An empty table gives no rows; other columns are not read. ``window`` is 36 at least.
    """
    if not 36 <= window <= 80:
        raise ValueError("windows of 36 to 80 bytes")
    scratch = Scratch(docs.sparkSession, "passages")
    blocks = pack_blocks(docs, scratch)
    buckets = bucket_count(blocks)
    left, width = window - GRAM, 2 * window - GRAM

    def ask(row: dict):
        block = Block(row["value"])
        _, g, of = _anchors(block, window)
        keys, many = _distinct(g, block.ids[of])
        cuts = split_by_bucket(keys, buckets)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = keys[cuts[k] : cuts[k + 1]] >> TRIM
            yield row["block"], k, squeeze(np.diff(part, prepend=np.uint64(0)), np.packbits(many[cuts[k] : cuts[k + 1]]))

    def shared(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        parts = []
        for _, value in rows:
            step, many = unsqueeze(value)
            parts.append((np.cumsum(step), np.unpackbits(many, count=len(step)).astype(bool)))
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        twice = np.r_[False, k[1:] == k[:-1]]
        twice[:-1] |= twice[1:]
        hit = np.empty(len(keys), bool)
        hit[order] = twice
        # Two grams whose trimmed hashes are equal also count as shared: that costs a comparison and changes no result.
        some = np.unique(keys[np.concatenate([p[1] for p in parts])])
        hit |= np.isin(keys, some)
        stops = np.cumsum([len(p[0]) for p in parts])
        return [(b, squeeze(np.packbits(hit[e - len(p[0]) : e]))) for (b, _), p, e in zip(rows, parts, stops.tolist(), strict=True) if hit[e - len(p[0]) : e].any()]

    flags = scratch.keep(by_bucket(each(blocks.select("block", "value"), ask, "block long, bucket int, value binary"), shared, buckets), "flags")

    def gather(block: Block, answers: dict[int, bytes]) -> pa.Table:
        """Rows for each bucket with the distinct contexts of candidates, and one (bucket -1) that remembers where they are."""
        at, g, of = _anchors(block, window)
        keys, _ = _distinct(g, block.ids[of])
        cuts = split_by_bucket(keys, buckets)
        hit = np.zeros(len(keys), bool)
        for k, value in answers.items():
            hit[cuts[k] : cuts[k + 1]] = np.unpackbits(unsqueeze(value)[0], count=int(cuts[k + 1] - cuts[k])).astype(bool)
        some = hit[np.searchsorted(keys, g)]
        at, g, of = at[some], g[some], of[some]
        out: list[tuple[int, bytes]] = []
        if len(at):
            both, before, after = _contexts(block, at, of, left, window)
            place = np.searchsorted(split_by_bucket_edges(buckets), g, side="right").astype(np.int32)
            whole = np.concatenate((place.astype(">i4").view(np.uint8).reshape(-1, 4), g.astype(">u8").view(np.uint8).reshape(-1, 8), both, before[:, None], after[:, None]), axis=1)
            _, pick, back = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
            least = np.full(len(pick), NO_ID)
            np.minimum.at(least, back, block.ids[of])
            where = np.searchsorted(place[pick], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(where)).tolist():
                p = pick[where[k] : where[k + 1]]
                out.append((k, squeeze(np.ascontiguousarray(both[p]).tobytes(), before[p], after[p], least[where[k] : where[k + 1]])))
            out.append((-1, squeeze(at.astype(np.int32), back.astype(np.int32), least, place[pick])))
        return pa.table({"bucket": pa.array([k for k, _ in out], pa.int32()), "value": pa.array([v for _, v in out], pa.binary())})

    def gathered(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        got = dict(zip(right_rows["bucket"].to_pylist(), right_rows["value"].to_pylist(), strict=True))
        if not len(left_rows) or not got:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "value": pa.array([], pa.binary())})
        t = gather(Block(left_rows["value"][0].as_py()), got)
        return t.add_column(0, "block", pa.array([left_rows["block"][0].as_py()] * len(t), pa.int64()))

    rows = blocks.select("block", "value").groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(gathered, "block long, bucket int, value binary")
    rows = scratch.keep(rows, "contexts")
    scratch.drop("flags")

    def verdicts(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
        parts = [unsqueeze(v) for _, v in rows]
        both = np.concatenate([np.frombuffer(p[0], np.uint8).reshape(-1, width) for p in parts])
        mask = covered_offsets(both, *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)), window)
        stops = np.cumsum([len(p[3]) for p in parts]).tolist()
        return [(b, squeeze(mask[e - len(p[3]) : e])) for (b, _), p, e in zip(rows, parts, stops, strict=True)]

    masks = scratch.keep(by_bucket(rows.where("bucket >= 0"), verdicts, buckets), "masks").unionByName(scratch.keep(rows.where("bucket < 0"), "places"))
    scratch.drop("contexts")  # the largest table; nothing reads it again

    def cut(block: Block, answers: dict[int, bytes]) -> pa.Table:
        begins = np.zeros(len(block.text) + 1, bool)
        if -1 in answers:
            at, back, least, place = unsqueeze(answers[-1])
            mask = np.zeros(len(least), np.int64)
            for k, value in answers.items():
                if k >= 0:
                    mask[place == k] = unsqueeze(value)[0]
            of = np.searchsorted(block.stops, at, side="right")
            at = at.astype(np.int64)
            before, after = at - block.starts[of], block.stops[of] - at
            later = block.ids[of] > least[back]
            bits = mask[back]
            for o in range(left + 1):
                whole = later & (before >= o) & (after >= window - o)
                begins[at[whole | ((bits >> o) & 1 > 0)] - o] = True
        sums = np.cumsum(begins)[:-1] if len(block.text) else np.empty(0, np.int64)
        gone = sums - np.r_[np.zeros(min(window, len(sums)), sums.dtype), sums[:-window]] > 0
        spans, kept = [], []
        for a, b in zip(block.starts.tolist(), block.stops.tolist(), strict=True):
            mine = gone[a:b]
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            spans.append([{"start": s, "stop": e} for s, e in edge.reshape(-1, 2).tolist()])
            kept.append(block.text[a:b][~mine].tobytes() if len(edge) else block.text[a:b].tobytes())
        ids = pa.array(block.ids, mask=block.ids == NO_ID)
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({"doc_id": ids, "n_bytes": pa.array(block.stops - block.starts, pa.int64()), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})

    return by_block(blocks, masks, cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def split_by_bucket_edges(buckets: int) -> np.ndarray:
    """The least key of each bucket but the first."""
    return (np.arange(1, buckets, dtype=object) * (2**64 // buckets)).astype(np.uint64)


def digest(found: DataFrame) -> DataFrame:
    """Counts and a checksum of what ``repeated_passages`` found."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
