"""Temperature mixing of sources, in DataFrame functions only.

A source's weight is its share of the tokens to the power of an exponent between 0 (all alike) and 1 (as they are), normalised. The exponent is
bisected to meet a target entropy, or the limit on repetition if that binds first. Weights become budgets: each source is read in
permuted blocks, whole epochs first and then as many documents of one more epoch as its budget still takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm.shared import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
#: Sources up to this number are broadcast (a few numbers each); more are joined by a shuffle.
MOST_BROADCAST = 10_000


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def exponent(shares: Column, entropy_share: float, most_repeats: float, budget_over_total: Column | None, steps: int = 50) -> Column:
    """The exponent for an array of positive shares, by bisection.

    It is the largest at which the entropy is at least ``entropy_share`` of what equal weights have, but not so small that a
    source would be read more than ``most_repeats`` times. Both fall as the exponent grows. Without a budget the source that is read least is read once.
    """

    def flat_enough(t: Column) -> Column:
        z = _sum(shares, lambda p: F.pow(p, t))
        entropy = F.log(z) - t * _sum(shares, lambda p: F.pow(p, t) * F.log(p)) / z
        return entropy >= entropy_share * F.log(F.size(shares).cast("double")) - 1e-12

    def too_often(t: Column) -> Column:
        if budget_over_total is None:
            return F.pow(F.array_min(shares) / F.array_max(shares), t - 1) > most_repeats
        z = _sum(shares, lambda p: F.pow(p, t))
        return budget_over_total * F.pow(F.array_min(shares), t - 1) / z > most_repeats

    def narrowed(s: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        up = flat_enough(mid) | too_often(mid)
        return F.struct(F.when(up, mid).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(mid).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: narrowed(s), lambda s: s["low"])
    return F.when(flat_enough(F.lit(1.0)), F.lit(1.0)).otherwise(found)


def _keys(doc_id: Column, source: Column, blocks: Column, epoch: Column, seed: int) -> tuple[Column, Column, Column]:
    """(block, the block's place in the epoch's permutation, the document's place in the block)."""
    block = F.pmod(F.xxhash64(doc_id, F.lit(seed)), blocks)
    return block, F.xxhash64(source, block, epoch, F.lit(seed + 1)), F.xxhash64(doc_id, epoch, F.lit(seed + 2))


def plan(sizes: DataFrame, scratch: Scratch, entropy_share: float, most_repeats: float, budget: float | None, at_least_once: bool, seed: int) -> DataFrame:
    """One row for each source of ``sizes`` (doc_id, source, n_tokens): weight, budget, whole epochs, and where the partial epoch stops.

    The partial epoch (its number is ``epochs``) takes the blocks before ``stop_block`` in that epoch's permutation, and of that block the
    documents up to ``stop_doc``. A source has about the square root of its documents as blocks, so neither the blocks of a source nor the
    documents of a block that are put in order exceed that, however large the source.
    """
    sources = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sources = scratch.keep(sources, "sources")
    one = sources.where("tokens > 0").agg(F.sum("tokens").cast("double").alias("total"), F.collect_list(F.col("tokens").cast("double")).alias("each"))
    shares = F.transform("each", lambda x: x / F.col("total"))
    over = None if at_least_once else F.lit(1.0) if budget is None else F.lit(float(budget)) / F.col("total")
    one = one.withColumn("shares", shares).withColumn("exponent", exponent(F.col("shares"), entropy_share, most_repeats, over))
    one = one.withColumn("z", _sum(F.col("shares"), lambda p: F.pow(p, F.col("exponent")))).select("total", "exponent", "z", "shares")
    # Read at least once: the budget at which the source that is read least is read in one whole epoch.
    least = F.array_min(F.transform("shares", lambda p: F.pow(p, F.col("exponent") - 1) / F.col("z")))
    scale = F.lit(1.0) / least if at_least_once else F.lit(1.0) if budget is None else F.lit(float(budget)) / F.col("total")
    one = one.select("total", "exponent", "z", scale.alias("scale"))
    rows = sources.withColumn("one", F.lit(1)).join(F.broadcast(one.withColumn("one", F.lit(1))), "one").drop("one")
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")).otherwise(F.lit(0.0))
    rows = rows.withColumn("weight", weight).withColumn("budget", F.col("weight") * F.col("scale") * F.col("total"))
    whole = F.floor(F.col("budget") / F.col("tokens") + 1e-9)
    rows = rows.withColumn("epochs", F.when(F.col("tokens") > 0, whole).otherwise(F.lit(1)).cast("long"))
    rows = rows.withColumn("rest", F.greatest(F.col("budget") - F.col("epochs") * F.col("tokens"), F.lit(0.0))).withColumn("blocks", F.greatest(F.ceil(F.sqrt("docs")), F.lit(1)).cast("long"))
    rows = scratch.keep(rows.drop("scale", "z", "total"), "weights")
    dealt = beside(sizes, rows.select("source", "epochs", "blocks", "rest"))
    block, block_key, doc_key = _keys(F.col("doc_id"), F.col("source"), F.col("blocks"), F.col("epochs"), seed)
    dealt = dealt.select("source", "rest", "n_tokens", block_key.alias("block_key"), doc_key.alias("doc_key"))
    by_block = dealt.groupBy("source", "block_key").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    w = Window.partitionBy("source").orderBy("block_key")
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stops = by_block.withColumn("before", before).where("before <= rest and before + tokens > rest")
    stops = scratch.keep(stops.groupBy("source").agg(F.min("block_key").alias("stop_block"), F.min_by("before", "block_key").alias("before")), "stops")
    inside = beside(dealt, stops).where("block_key = stop_block").groupBy("source", "doc_key", "rest", "before").agg(F.sum("n_tokens").alias("n_tokens"))
    up_to = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("doc_key")) + F.col("before")
    last = inside.withColumn("up_to", up_to).where("up_to <= rest").groupBy("source").agg(F.max("doc_key").alias("stop_doc"))
    return scratch.keep(rows.join(stops.select("source", "stop_block"), "source", "left").join(last, "source", "left"), "plan")


def beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with what ``sources`` says of their source; a hot source is not shuffled while there are few."""
    few = sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(sources) if few else sources, "source")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens) of documents: tokens are words between ASCII white space, null text has none, null source counts as ''."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), words.cast("long").alias("n_tokens"))


def drawn(rows: DataFrame, plan_: DataFrame, seed: int) -> DataFrame:
    """Each row (doc_id, source, ...) once for each epoch that reads it, with epoch, block, block_key and doc_key.

    Reading an epoch in the order of (block_key, doc_key) is its block permutation.
    """
    rows = beside(rows, plan_.select("source", "epochs", "blocks", "rest", "stop_block", "stop_doc", "tokens"))
    _, block_key, doc_key = _keys(F.col("doc_id"), F.col("source"), F.col("blocks"), F.col("epochs"), seed)
    ahead = (block_key < F.col("stop_block")) | ((block_key == F.col("stop_block")) & (doc_key <= F.col("stop_doc")))
    partial = (F.col("tokens") > 0) & (F.col("rest") > 0) & F.coalesce(ahead, F.lit(False))
    times = F.col("epochs") + partial.cast("long")
    rows = rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    block, block_key, doc_key = _keys(F.col("doc_id"), F.col("source"), F.col("blocks"), F.col("epoch"), seed)
    return rows.withColumn("block", block).withColumn("block_key", block_key).withColumn("doc_key", doc_key).drop("epochs", "blocks", "rest", "stop_block", "stop_doc", "tokens")


def mix(docs: DataFrame, entropy_share: float = 0.95, most_repeats: float = 4.0, budget: float | None = None, at_least_once: bool = False, seed: int = 42) -> DataFrame:
    """Draws documents (doc_id, text, source) so that their sources' tokens follow tempered weights.

    Returns one row for each document and epoch that reads it: doc_id, source, n_tokens, epoch, block, block_key, doc_key, weight. ``budget`` is in tokens and is
    the corpus's own number if not given; with ``at_least_once`` it is as much as reads every document once or more. A source's draws never exceed its budget. Sources without tokens have no weight and
    are read once. Rows that share a doc_id are drawn together, null ids are an id like others, an empty table gives no rows, other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(measured(docs), "sizes")
    of = plan(sizes, scratch, entropy_share, most_repeats, budget, at_least_once, seed)
    return beside(drawn(sizes, of, seed), of.select("source", "weight"))


def mixed_documents(docs: DataFrame, entropy_share: float = 0.95, most_repeats: float = 4.0, seed: int = 42) -> DataFrame:
    """The documents themselves, each as often as ``mix`` with ``at_least_once`` draws it, with the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    of = plan(scratch.keep(measured(docs), "sizes"), scratch, entropy_share, most_repeats, None, True, seed)
    whole = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.struct("*").alias("__row"))
    return drawn(whole, of, seed).select("__row.*")
