"""Order MinHash fingerprints, in DataFrame functions only.

A text is cut into pieces: a word of up to eight characters with the blanks before it, or a part of a longer run without blanks. Such runs are cut by content, after characters of a fixed
class, so that pieces behind an insertion stay as they were, in scripts without blanks too. k-mers are k neighbouring pieces, and equal k-mers are numbered by occurrence. One hash deals the numbered k-mers to ``bins``; each bin's two least, in text
order, are hashed as a pair. Texts agree in a bin only if the same k-mers stand there in the same order, so likeness follows edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm.shared import Scratch, parallelism



def _every(first: int, last: int, wide: int, step: int) -> str:
    """The part of a character class that takes ``wide`` code points of each ``step`` from first to last."""
    return "".join(f"\\u{c:04X}-\\u{min(c + wide - 1, last):04X}" for c in range(first, last + 1, step))


#: Characters that end a piece of a long run: about a fifth of each script's.
ENDS = "aeouAEOU048\\p{Punct}" + _every(0x0400, 0x06FF, 8, 40) + _every(0x0900, 0x0DFF, 8, 40) + _every(0x3040, 0x30FF, 16, 64) + _every(0x4E00, 0x9FFF, 256, 1312) + _every(0xAC00, 0xD7A3, 280, 1400)
PIECES = rf"\s*(?:\S{{1,8}}(?!\S)|\S{{2}}[^\s{ENDS}]{{0,5}}[{ENDS}]|\S{{1,8}})|\s+"
#: Low bits of a packed long that hold a k-mer's place: more places than a string of Spark's can have pieces of eight bytes.
PLACE_BITS = 28
PLACE = (1 << PLACE_BITS) - 1


def _hash_part(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _occurrence(packed: str, j: Column, x: Column) -> Column:
    """How many equal k-mers stand before the j-th of the sorted array, by steps of falling powers of two."""
    steps = F.array(*(F.lit(1 << b) for b in range(PLACE_BITS - 1, -1, -1)))
    back = F.aggregate(steps, F.lit(0), lambda q, step: F.when((j - q - step >= 0) & (_hash_part(F.get(F.col(packed), j - q - step)) == _hash_part(x)), q + step).otherwise(q))
    return F.when((j > 0) & (_hash_part(F.get(F.col(packed), j - 1)) == _hash_part(x)), back).otherwise(F.lit(0))


def with_signature(df: DataFrame, text: str, into: str, k: int = 3, bins: int = 64) -> DataFrame:
    """``df`` with the signature of column ``text`` in column ``into``: an array with an int for each bin that has k-mers.

    The int holds the bin and 16 bits of the hash of its k-mers. An empty or null text has an empty signature; a text of fewer
    than k pieces is one k-mer. Every bin looks at the whole text.
    """
    pieces, first, second = (f"__{into}_{x}" for x in ("pieces", "first", "second"))
    width = (bins - 1).bit_length()
    df = df.withColumn(pieces, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECES), F.lit(0)))
    last = F.greatest(F.size(pieces) - k, F.lit(0))

    def kmer(i: Column) -> Column:
        h = F.xxhash64(*(F.get(F.col(pieces), i + d) for d in range(k)))
        return h.bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.least(i, F.lit(PLACE)).cast("long"))

    packed = F.when(F.size(pieces) > 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), kmer))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(first, packed).drop(pieces)
    numbered = F.transform(first, lambda x, j: F.xxhash64(_hash_part(x), _occurrence(first, j, x)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE))))
    df = df.withColumn(second, F.sort_array(numbered)).drop(first)

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - width)

    def pair(j: Column) -> Column:
        a, b = F.get(F.col(second), j), F.get(F.col(second), j + 1)
        alone = b.isNull() | (bin_of(b) != bin_of(a))
        ahead = a.bitwiseAND(F.lit(PLACE)) < b.bitwiseAND(F.lit(PLACE))
        h = F.when(alone, F.xxhash64(_hash_part(a))).when(ahead, F.xxhash64(_hash_part(a), _hash_part(b))).otherwise(F.xxhash64(_hash_part(b), _hash_part(a)))
        return (F.shiftleft(bin_of(a), 16) + h.bitwiseAND(F.lit(0xFFFF))).cast("int")

    heads = F.filter(F.sequence(F.lit(0), F.size(second) - 1), lambda j: (j == 0) | (bin_of(F.get(F.col(second), j)) != bin_of(F.get(F.col(second), j - 1))))
    return df.withColumn(into, F.when(F.size(second) > 0, F.transform(heads, pair)).otherwise(F.array().cast("array<int>"))).drop(second)


def likeness(a: Column, b: Column) -> Column:
    """The share of bins in which two signatures agree, 0 to 1; two empty texts are alike."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def as_text(signature: Column) -> Column:
    """Six hexadecimal digits for each bin."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def followers(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``ids`` (doc_id, distinct) with next_id, the next in descending order; the first follows the last, null comes last.

    Ids are dealt by range, each range finds its own next ones, and a table with a row for each range joins the ends.
    """
    ranged = scratch.keep(ids.repartitionByRange(parallelism(ids.sparkSession), F.col("doc_id").desc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    order = F.col("doc_id").desc_nulls_last()
    inside = Window.partitionBy("part").orderBy(order)
    rows = ranged.withColumn("next_id", F.lead("doc_id").over(inside)).withColumn("last", F.lead(F.lit(1)).over(inside).isNull())
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"))  # of a range with a null id only, null
    each = Window.orderBy("part")
    every = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.when(F.lead(F.lit(1)).over(each).isNull(), F.first("head").over(every)).otherwise(F.lead("head").over(each))
    ends = heads.select("part", after.alias("after"))
    return rows.join(F.broadcast(ends), "part").withColumn("next_id", F.when(F.col("last"), F.col("after")).otherwise(F.col("next_id"))).drop("part", "last", "after")


def fingerprint_edits(docs: DataFrame, k: int = 3, bins: int = 64) -> DataFrame:
    """Signatures of every row of ``docs`` (doc_id, text) and of its edited text.

    The edit puts the first floor(n_chars / 3) code points of the next document (descending doc_id; after the last the first; all, if it has fewer) in
    place of as many at the end. Returns doc_id, n_chars, edited_sha256, signature, edited_signature, near_edited and near_next (likeness to the edited text
    and to the next document). A null text is the empty text, a null doc_id comes last in the order. Rows that share a doc_id have one place in the order;
    the text with the least hash among them stands for it, and all come back. A single document is its own next. Other columns are not read, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "omh")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("text_hash"), F.max(F.char_length("text")).alias("most"), F.count("*").alias("n"))
    links = scratch.keep(followers(ids, scratch), "links")
    donors = links.select(F.col("next_id").alias("donor"), F.col("doc_id").alias("taker"), F.floor(F.col("most") / 3).cast("int").alias("take"))
    hashes = links.select(F.col("doc_id").alias("of"), "text_hash")
    once = links.where("n > 1").isEmpty()
    gifts = docs.join(donors, F.col("doc_id").eqNullSafe(F.col("donor"))).select("doc_id", "taker", F.substring("text", F.lit(1), F.col("take")).alias("gift"), *([] if once else ["text"]))
    if not once:
        gifts = gifts.join(hashes, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("text_hash"))).groupBy("taker").agg(F.max("gift").alias("gift"))
    gifts = gifts.select("taker", "gift")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("gift", F.lit(1), third))
    rows = docs.join(gifts, F.col("doc_id").eqNullSafe(F.col("taker"))).select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_signature(rows, "text", "signature", k, bins)
    rows = with_signature(rows.drop("text") if once else rows, "edited", "edited_signature", k, bins)
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("near_edited", likeness(F.col("signature"), F.col("edited_signature"))).drop("edited")
    if not once:
        rows = rows.withColumn("text_hash", F.xxhash64("text")).drop("text")
    rows = scratch.keep(rows, "signatures")
    nexts = rows.select(F.col("doc_id").alias("donor"), F.col("signature").alias("next_signature"), *([] if once else ["text_hash"]))
    if not once:
        nexts = nexts.join(hashes.withColumnRenamed("text_hash", "least"), F.col("donor").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("least"))).groupBy("donor").agg(F.max("next_signature").alias("next_signature"))
    nexts = nexts.join(donors.select(F.col("donor").alias("from"), "taker"), F.col("donor").eqNullSafe(F.col("from"))).select("taker", "next_signature")
    found = rows.join(nexts, F.col("doc_id").eqNullSafe(F.col("taker")))
    return found.select("doc_id", "n_chars", "edited_sha256", "signature", "edited_signature", "near_edited", likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
