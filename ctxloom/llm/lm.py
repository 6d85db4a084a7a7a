"""N-gram language model by deleted interpolation.

Maximum-likelihood estimates of orders 3, 2 and 1 and a uniform share are mixed. How much each weighs depends on how
often the context was seen: contexts fall into frequency buckets, and each bucket has its own weights, learned by expectation-maximisation
on counts of a held-out fold of the training documents, with the fold's own counts deleted from the estimates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.anchors import MIX, mixed
from ctxloom.llm.blocks import NO_ID, Block, bucket_count, by_block, by_bucket, each, pack_blocks, split_by_bucket, squeeze, unsqueeze
from ctxloom.llm.shared import Scratch, remainder

#: Words hold no blanks, so these marks are none.
BEGIN, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" begin", b" end"))
HELD_OUT, FOLD, TRAIN = 0, 1, 2
#: Buckets of the count of (u, v), then of v where (u, v) is new, then one for a new v.
PAIR_BUCKETS, WORD_BUCKETS = 12, 20
GRID = 96


class Tokens:
    """The tokens of a block: for each target its unigram, bigram and trigram key, and where documents begin."""

    def __init__(self, block: Block):
        names: dict[bytes, int] = {}
        place: list[int] = []
        sizes = []
        for text in block.texts():
            words = text.lower().split()
            place += [names.setdefault(w, len(names)) for w in words]
            place.append(-1)
            sizes.append(len(words) + 1)
        table = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
        h = np.append(table, END)[np.array(place, np.int64)]
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        one = self.before(h, BEGIN)
        two = self.before(one, BEGIN)
        pair = mixed(one * MIX[0] + h)
        self.keys = [mixed(h), pair, mixed((two * MIX[1]) ^ pair)]

    def before(self, values: np.ndarray, at_start: object) -> np.ndarray:
        """What stands one token earlier."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_start
        return out


def _trims(blocks: DataFrame) -> tuple[np.uint64, ...]:
    """Low bits of the keys that are not sent, by order. Words keep all 64. Of longer n-grams 20 bits more than it takes to number
    the corpus's bytes are sent: about one in a million of their counts holds another n-gram's, at any size."""
    bits = min(64, max(1, int(blocks.agg(F.sum("n_bytes")).first()[0] or 0)).bit_length() + 18)
    return np.uint64(0), np.uint64(64 - bits), np.uint64(64 - bits)


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, or in 64 where one needs them."""
    return n.astype(np.uint64 if len(n) and n.max() >= 1 << 32 else np.uint32)


def _send(row: dict, buckets: int, trims: tuple[np.uint64, ...]):
    """For each bucket: the role, and for each order the distinct keys with their counts in the block."""
    tokens = Tokens(Block(row["value"]))
    parts: dict[int, list] = {}
    for k in range(3):
        keys = np.sort(tokens.keys[k])
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = _narrow(np.diff(np.r_[first, len(keys)]))
        keys = keys[first]
        cuts = split_by_bucket(keys, buckets)
        for b in range(buckets):
            parts.setdefault(b, []).extend((np.diff(keys[cuts[b] : cuts[b + 1]] >> trims[k], prepend=np.uint64(0)), n[cuts[b] : cuts[b + 1]]))
    for b, arrays in parts.items():
        if any(len(a) for a in arrays):
            yield row["block"], b, squeeze(np.array([row["role"]]), *arrays)


def _merge(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """For each block, in the order of its keys, the counts over all training documents and over the fold.

    One more row, of block -1, has the bucket's training tokens and distinct training words, and the fold's tokens.
    """
    parts = [unsqueeze(v) for _, v in rows]
    answers: list[list[np.ndarray]] = [[] for _ in rows]
    stats = np.zeros(3, np.int64)
    for k in range(3):
        keys = [np.cumsum(p[1 + 2 * k]) for p in parts]
        whole = np.concatenate(keys)
        role = np.repeat([p[0][0] for p in parts], [len(x) for x in keys])
        n = np.concatenate([p[2 + 2 * k] for p in parts]).astype(np.int64)
        order = np.argsort(whole)
        w = whole[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(w)])
        both = []
        for of in (role != HELD_OUT, role == FOLD):
            sums = np.add.reduceat((n * of)[order], first) if len(w) else np.empty(0, np.int64)
            if not k:
                stats[len(both) * 2] += sums.sum()
                stats[1] += 0 if both else (sums > 0).sum()
            out = np.empty(len(w), np.int64)
            out[order] = np.repeat(sums, size)
            both.append(out)
        at = 0
        for j, x in enumerate(keys):
            answers[j] += [_narrow(both[0][at : at + len(x)]), _narrow(both[1][at : at + len(x)]) if parts[j][0][0] == FOLD else np.empty(0, np.uint32)]
            at += len(x)
    return [(b, squeeze(*a)) for (b, _), a in zip(rows, answers, strict=True)] + [(-1, squeeze(stats))]


def _counts(tokens: Tokens, answers: dict[int, bytes], fold: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each target's counts of orders 1 to 3 over all training documents, and over the fold."""
    got = {b: unsqueeze(v) for b, v in sorted(answers.items())}
    out: tuple[list, list] = ([], [])
    for k in range(3):
        order = np.argsort(tokens.keys[k])
        keys = tokens.keys[k][order]
        place = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
        for j in range(1 + fold):
            table = np.concatenate([a[2 * k + j] for a in got.values()]).astype(np.int64)
            c = np.empty(len(keys), np.int64)
            c[order] = table[place]
            out[j].append(c)
    return out


def estimates(tokens: Tokens, counts: list[np.ndarray], n_docs: int, n_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, shares): the context's frequency bucket, and the estimates of orders 3, 2 and 1 (0 where the context is new).

    A count that holds another n-gram's (see ``_trims``) can exceed its context's, which is its bound: no share is above 1.
    """
    one, two, three = counts
    context = tokens.before(one, n_docs)
    two = np.minimum(two, context)
    wide = tokens.before(two, n_docs)
    three = np.minimum(three, wide)
    shares = np.stack((three / np.maximum(wide, 1), two / np.maximum(context, 1), one / max(n_tokens, 1)))
    level = lambda c, most: np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), most - 1)
    bucket = np.where(wide > 0, level(wide, PAIR_BUCKETS), np.where(context > 0, PAIR_BUCKETS + level(context, WORD_BUCKETS), PAIR_BUCKETS + WORD_BUCKETS))
    return bucket, shares


def _on_grid(shares: np.ndarray) -> np.ndarray:
    """Estimates to the nearest half octave; GRID - 1 stands for 0."""
    return np.where(shares > 0, np.minimum(np.rint(-2 * np.log2(np.maximum(shares, 1e-300))), GRID - 2), GRID - 1).astype(np.int64)


def learn_weights(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Mixture weights (bucket, order 3, 2, 1 and uniform) by expectation-maximisation over counted grid cells.

    A component that a bucket cannot have gets no weight; a bucket with no held-out token keeps the weights it started with.
    """
    of = PAIR_BUCKETS + WORD_BUCKETS + 1
    start = np.full((of, 4), 0.25)
    start[PAIR_BUCKETS:, 0] = 0
    start[-1, 1] = 0
    weights = start / start.sum(axis=1, keepdims=True)
    if not len(cells):
        return weights
    bucket, grid = cells // GRID**3, np.stack([cells // GRID**2 % GRID, cells // GRID % GRID, cells % GRID])
    shares = np.vstack((np.where(grid < GRID - 1, 2.0 ** (-grid / 2), 0.0), np.full(len(cells), uniform)))
    for _ in range(rounds):
        part = weights[bucket].T * shares
        part *= n / np.maximum(part.sum(axis=0), 1e-300)
        sums = np.stack([np.bincount(bucket, p, of) for p in part], axis=1) + 1e-3 * (start > 0)
        fresh = sums / sums.sum(axis=1, keepdims=True)
        if np.abs(fresh - weights).max() < 1e-6:
            return fresh
        weights = fresh
    return weights


def score_corpus(docs: DataFrame, role: Column | None = None, unigram_add: float = 0.1) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text) with a model learned from those whose ``role`` is FOLD or TRAIN.

    Without ``role``, documents whose crc32 of the id modulo 10 is 0 are held out and remainder 1 is the fold that teaches the weights.
    Tokens: ASCII letters in lower case, words between ASCII white space, and an end. Returns doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (additive unigrams) and score, log10 probabilities of the whole text. A null text is the
    empty text: its end alone is scored. A null doc_id has remainder 0. Repeated rows count and come back as often as they come, other
    columns are not read, an empty table gives no rows; without training documents every share is uniform.
    Only the weights' grid of held-out counts (GRID cells for each order and bucket, whatever the input) reaches the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    if role is None:
        r = F.coalesce(remainder("doc_id", 10), F.lit(0))
        role = F.when(r == 0, HELD_OUT).when(r == 1, FOLD).otherwise(TRAIN)
    blocks = pack_blocks(docs, scratch, role)
    buckets = bucket_count(blocks)
    trims = _trims(blocks)
    sent = each(blocks.select("block", "role", "value"), lambda row: _send(row, buckets, trims), "block long, bucket int, value binary")
    answers = scratch.keep(by_bucket(sent, _merge, buckets), "answers")
    sums = each(answers.where("block < 0").select("value"), lambda row: [tuple(unsqueeze(row["value"])[0].tolist())], "n long, v long, f long").agg(F.sum("n"), F.sum("v"), F.sum("f")).first()
    n_tokens, n_words, fold_tokens = (int(x or 0) for x in sums)
    by_role = {x["role"]: x["n"] for x in blocks.groupBy("role").agg(F.sum("n_docs").alias("n")).collect()}
    fold_docs, n_docs = by_role.get(FOLD, 0), by_role.get(FOLD, 0) + by_role.get(TRAIN, 0)

    def count_cells(block: Block, got: dict[int, bytes]) -> pa.Table:
        tokens = Tokens(block)
        total, own = _counts(tokens, got, True)
        bucket, shares = estimates(tokens, [a - b for a, b in zip(total, own, strict=True)], n_docs - fold_docs, n_tokens - fold_tokens)
        grid = _on_grid(shares)
        cell, n = np.unique(((bucket * GRID + grid[0]) * GRID + grid[1]) * GRID + grid[2], return_counts=True)
        return pa.table({"cell": cell, "n": n})

    fold = blocks.where(F.col("role") == FOLD)
    seen = by_block(fold, answers.join(fold.select("block"), "block", "left_semi"), count_cells, "cell long, n long")
    cells = seen.groupBy("cell").agg(F.sum("n").alias("n")).toArrow() if fold_docs and n_docs > fold_docs else None
    uniform = 1 / (n_words + 1)
    weights = learn_weights(cells["cell"].to_numpy(), cells["n"].to_numpy(), uniform) if cells is not None else learn_weights(np.empty(0, np.int64), np.empty(0), uniform)

    def score(block: Block, got: dict[int, bytes]) -> pa.Table:
        tokens = Tokens(block)
        counts = _counts(tokens, got, False)[0]
        bucket, shares = estimates(tokens, counts, n_docs, n_tokens)
        p = (weights[bucket].T * np.vstack((shares, np.full((1, len(bucket)), uniform)))).sum(axis=0)
        base = np.log10((counts[0] + unigram_add) / (n_tokens + unigram_add * (n_words + 1)))
        add = lambda x: np.add.reduceat(x, tokens.first)
        return pa.table({"doc_id": pa.array(block.ids, mask=block.ids == NO_ID), "n_tokens": tokens.sizes, "n_known": add((counts[0] > 0).astype(np.int64)), "train_tokens": np.full(len(block.ids), n_tokens), "base_score": add(base), "score": add(np.log10(np.maximum(p, 1e-300)))})

    found = by_block(blocks, answers.where("block >= 0"), score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found
