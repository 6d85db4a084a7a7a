"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines are compared by their sets of character shingles. Hashes of the shingles, each held against fixed corners, give a signature of least values;
bands of it find candidates, whole shingle sets verify them, and connected components keep one line each.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm.components import connected_components
from ctxloom.llm.shared import Scratch, parallelism, setting, unused

SHINGLE, ROWS = 8, 5
#: Corners that a shingle is held against, out of four times as many: its hash's two high bits choose them.
TOGETHER = 10
#: Lines of fewer than FEW words are signed by all their shingles (kind 0), those of MANY to MORE - 1 by the shingles at their words' starts and middles (kind 1), those of MOST or more by
#: the ones at their words' starts (kind 2). Lines in between have two signatures, so that lines of similar length share a kind and seldom miss a band. Fewer shingles a line would make bands of one or two frequent
#: shingles, which lines that have nothing else in common share.
MANY, FEW, MOST, MORE = 24, 40, 40, 64
#: Words that a shingle at a word's start can reach into.
REACH = 5
#: Further rounds with a lead, and what rounding may do to a number of shingles.
ROUNDS, MARGIN = 1, 1e-9
#: In buckets of at most so many lines, those that leads leave apart are compared one by one: a line then meets no more than this less one.
SMALL = 8
#: Rows of two or three numbers are broadcast up to this number, beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Links (two numbers each) that the driver joins by itself; more take rounds of joins.
MOST_LINKS = 50_000
#: Likewise for the lines whose texts are read again, as without a broadcast all lines' texts are shuffled.
MOST_TEXTS = 500_000
#: Spark's switch that aggregates rows which are sorted by their keys in that order, without a hash map. A line's signatures are.
BY_ORDER = "spark.sql.execution.replaceHashWithSortAgg"
#: Removed lines of a document that are broadcast; longer lists go by a shuffle.
MOST_LINES = 100


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, row, line_no, norm, line) of every line; ``line`` hashes the normalised text and is null for lines that are too short to compare, ``row`` is the document's (see ``_row``)."""
    split = docs.select("doc_id", _row().alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    split = split.select("doc_id", "row", "line_no", F.lower(F.trim("text")).alias("norm"))
    return split.select("doc_id", "row", "line_no", "norm", F.when(F.char_length("norm") >= least, F.xxhash64("norm")).alias("line"))


def _row() -> Column:
    """A hash of a document's id and text: rows that repeat an id, or have none, are told apart unless they are equal."""
    return F.xxhash64("doc_id", "text")


def _texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(line, norm) of the lines of ``wanted`` (line, of), each read from one place in a document that has it first: other lines are not normalised again, and documents without such a place are not split."""
    at = lines.where("line is not null").join(wanted, "line").where("doc_id <=> of").groupBy("line").agg(F.min(F.struct("row", "line_no")).alias("at"))
    at = at.groupBy(F.col("at.row").alias("row")).agg(F.collect_list(F.struct("line", F.col("at.line_no").alias("line_no"))).alias("found"))
    at = _few(at, scratch, "places", MOST_TEXTS)
    rows = docs.withColumn("row", _row()).join(at, "row").select(F.split(F.coalesce("text", F.lit("")), "\n").alias("split"), "found").select("split", F.explode("found").alias("at"))
    rows = rows.select("at.line", F.lower(F.trim(F.get("split", F.col("at.line_no")))).alias("norm"))
    return rows.groupBy("line").agg(F.max("norm").alias("norm"))


def _signed(lines: DataFrame) -> DataFrame:
    """(line, n, min_doc, bands), one row for each distinct line; bands has a hash for each run of ROWS least values, n is how often a line occurs, min_doc where first.

    The hash of a shingle, XORed with a corner, is its distance from that corner, and each corner keeps its least one. Corners differ in their high bits, so each looks at
    shingles of its own where there are enough. Equal lines become one before they are dealt; shingles stay in the task of their line, so that no signature is shuffled.
    """
    lines = lines.where("line is not null").groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("min_doc"), F.max("norm").alias("norm"))
    # Split once, and without lambdas, which would have this generator interpreted.
    lines = lines.withColumn("split", F.split("norm", " ")).withColumn("count", F.size("split"))
    count, of = F.col("count"), lambda *kinds: F.array(*map(F.lit, kinds))
    kinds = F.when(count < MANY, of(0)).when(count < FEW, of(0, 1)).when(count < MOST, of(1)).when(count < MORE, of(1, 2)).otherwise(of(2))
    words = F.when(count >= MANY, F.col("split"))
    # In UTF-32 characters have fixed places. Both forms are made below the generators; in one select with them Spark would make them anew for every shingle.
    wide = F.when(count < FEW, F.encode("norm", "UTF-32"))
    rows = lines.select("n", "min_doc", "line", words.alias("words"), wide.alias("wide"), (F.char_length("norm") - SHINGLE).alias("last"), F.explode(kinds).alias("kind"))
    places = F.sequence(F.lit(0), F.when(F.col("kind") == 0, F.greatest("last", F.lit(0))).otherwise(F.size("words") * (3 - F.col("kind")) - 1))
    rows = rows.select("n", "min_doc", "line", "kind", "words", "wide", F.explode(places).alias("i"))
    # Of kind 1 even places are words' starts, odd ones their middles.
    word = F.when(F.col("kind") == 1, F.shiftright("i", 1)).otherwise(F.col("i"))
    begin = F.when((F.col("kind") == 1) & (F.col("i") % 2 == 1), F.shiftright(F.char_length(F.get("words", word)) + 1, 1)).otherwise(0)
    # Two words mostly hold the shingle.
    joined = lambda reach: F.concat_ws(" ", *(F.get("words", word + k) for k in range(reach)))
    rows = rows.select("n", "min_doc", "line", "kind", "words", "wide", "i", F.when(F.col("kind") > 0, begin).alias("begin"), F.when(F.col("kind") > 0, joined(2)).alias("two"))
    text = F.when(F.char_length("two") >= F.col("begin") + SHINGLE, F.col("two")).otherwise(joined(REACH))
    by_word = F.xxhash64(F.substring(text, F.col("begin") + 1, F.lit(SHINGLE)))
    by_place = F.xxhash64(F.substring("wide", F.col("i") * 4 + 1, F.lit(4 * SHINGLE)))
    rows = rows.select("n", "min_doc", "line", "kind", F.shiftright(F.when(F.col("kind") == 0, by_place).otherwise(by_word), 32).cast("int").alias("h"))
    # The two high bits say which corners a shingle is held against: each row of an aggregate has few columns then.
    # Fifteen more bits make a distance.
    corners = [(k << 15) // TOGETHER for k in range(TOGETHER)]
    part, inside = F.shiftrightunsigned("h", 30), F.shiftright(F.col("h"), 15).bitwiseAND(F.lit((1 << 15) - 1))
    rows = rows.select("n", "min_doc", "line", "kind", part.cast("byte").alias("part"), inside.alias("h"))
    least = [F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{k}") for k, c in enumerate(corners)]
    rows = rows.groupBy("line", "kind", "part").agg(F.max("n").alias("n"), F.min("min_doc").alias("min_doc"), *least)
    bands = [F.xxhash64("kind", "part", F.lit(b), *(F.col(f"m{b * ROWS + k}") for k in range(ROWS))) for b in range(TOGETHER // ROWS)]
    rows = rows.select("line", "n", "min_doc", (F.col("kind") * 4 + F.col("part")).alias("slot"), *(band.alias(f"b{b}") for b, band in enumerate(bands)))
    # One row a line, in the same task.
    slots = [(slot, b) for slot in range(12) for b in range(len(bands))]
    rows = rows.groupBy("line").agg(F.max("n").alias("n"), F.min("min_doc").alias("min_doc"), *(F.max(F.when(F.col("slot") == slot, F.col(f"b{b}"))).alias(f"s{slot}_{b}") for slot, b in slots))
    return rows.select("line", "n", "min_doc", F.array_compact(F.array(*(f"s{slot}_{b}" for slot, b in slots))).alias("bands"))


def _shingle_set(text: Column) -> Column:
    """Hashes of the distinct shingles of a normalised line; a line shorter than one is its own."""
    last = F.greatest(F.char_length(text) - SHINGLE, F.lit(0))
    places = F.sequence(F.lit(1), last * 4 + 1, F.lit(4))
    every = F.transform(F.array(F.encode(text, "UTF-32")), lambda wide: F.transform(places, lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * SHINGLE)))))
    return F.array_distinct(F.get(every, F.lit(0)))


def _with_sets(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``mine`` and ``its``, the shingle sets of a and b; those of the b's, which are fewer, are made once each."""
    pairs = pairs.join(texts.select(F.col("line").alias("a"), "norm"), "a")
    of = pairs.select("b").distinct().join(texts.select(F.col("line").alias("b"), F.col("norm").alias("text")), "b").select("b", _shingle_set(F.col("text")).alias("its"))
    return pairs.join(of, "b").withColumn("mine", _shingle_set(F.col("norm"))).drop("norm")


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, alike): whether the exact Jaccard likeness of each pair's shingle sets is ``similarity`` or more."""
    dealt = pairs.repartition(parallelism(pairs.sparkSession), "a")  # the work of a pair is large for its bytes
    rows = _with_sets(dealt, texts).withColumn("common", F.size(F.array_intersect("mine", "its")))
    return rows.select("a", "b", (F.col("common") >= similarity * (F.size("mine") + F.size("its") - F.col("common")) - MARGIN).alias("alike"))


def _few(rows: DataFrame, scratch: Scratch, name: str, most: int) -> DataFrame:
    """``rows``, written; with a broadcast hint while they are no more than ``most``."""
    rows = scratch.keep(rows, name, small=True)
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _with_parts(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with part_a and part_b, the components of both; a line without links is its own."""
    of = parts.select(F.col("node"), "component")
    for x in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")), x, "left").withColumn(f"part_{x}", F.coalesce(f"part_{x}", x))
    return pairs


def _joined(links: DataFrame) -> DataFrame:
    """(node, component), as ``connected_components`` has it, of links (src, dst) that are few enough for the driver."""
    rows, up = links.toArrow(), {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(rows["src"].to_pylist(), rows["dst"].to_pylist(), strict=True):
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return links.sparkSession.createDataFrame(pa.table({"node": pa.array(list(up), pa.int64()), "component": pa.array([top(x) for x in list(up)], pa.int64())}))


class _Parts:
    """Components that grow: links join components, of which only those that change are looked at."""

    def __init__(self, spark, scratch: Scratch):
        self.scratch, self.k = scratch, 0
        self.now = spark.createDataFrame([], "node long, component long")

    def add(self, pairs: DataFrame) -> bool:
        """Joins what ``pairs`` (a, b) link; false if they link nothing new."""
        links = self.scratch.keep(_with_parts(pairs, self.now).where("part_a <> part_b").select(F.col("part_a").alias("src"), F.col("part_b").alias("dst")).distinct(), f"links{self.k}")
        found = links.limit(MOST_LINKS + 1).count()
        if not found:
            return False
        moved = (F.broadcast(_joined(links)) if found <= MOST_LINKS else connected_components(links, self.scratch)).withColumnRenamed("component", "to")
        old = self.now.join(moved.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        fresh = moved.join(self.now, "node", "left_anti").select("node", F.col("to").alias("component"))
        self.now = _few(old.unionByName(fresh), self.scratch, f"parts{self.k}", MOST_BROADCAST)
        self.scratch.drop(f"links{self.k}", *([f"parts{self.k - 1}"] if self.k else []))
        self.k += 1
        return True


def _meetings(rows: DataFrame, similarity: float) -> DataFrame:
    """(lead, a, b): a row for each difference in which a pair of ``rows`` meets and after which either line has as many left as the pair needs; see ``_partners``."""
    q = (1 - similarity) / (1 + similarity)
    v = rows.where("loose").select("lead", "x", F.col("line").alias("a"), F.col("part").alias("part_a"), F.col("own").alias("own_a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.col("met").alias("met_a"))
    w = rows.where("met").select("lead", "x", F.col("line").alias("b"), F.col("part").alias("part_b"), F.col("own").alias("own_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("loose").alias("loose_b"))
    need = (F.col("n_a") + F.col("n_b") - q * (F.col("own_a") + F.col("own_b"))) / 2 - MARGIN
    # Where both directions of a pair meet in x, one of them is made.
    shared = v.join(w, ["lead", "x"]).where("part_a <> part_b and (a < b or not (met_a and loose_b))").where(F.least("own_a", "own_b") >= similarity * F.greatest("own_a", "own_b") - MARGIN)
    shared = shared.where(F.least("rest_a", "rest_b") + 1 >= need)
    return shared.select("lead", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _partners(groups: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of lines of one lead in ``groups`` (a: line, b: lead, part_a, part_b) that are alike and in different components.

    One line of such a pair, v, is loose: in another component than the lead, and so more than r = 1 - ``similarity`` from it. Let D be a line's set of differences from the lead (shingles that one has
    and the other lacks) and A its shingles, L the lead's. Lines v and w are |D(v)| + |D(w)| - 2 s differences apart, s being those they share, and within r only if that is at most q (|A(v)| + |A(w)|),
    q = r / (2 - r). So s >= |D(w)| - q (|A(v)| + |A(w)|), likewise for v, and as |D(v)| > q (|A(v)| + |L|), also s >= (|D(w)| + q (|L| - |A(w)|)) / 2. Two sets that share s elements share one
    among the first |D| - s + 1 of each in any one order, at most about a quarter of |A| here. The order takes the differences that the fewest lines of the lead have first, so that few lines meet by chance.

    Both lines of a pair that meets are known, and so is what they have to share: s >= t = (|D(v)| + |D(w)| - q (|A(v)| + |A(w)|)) / 2. In the one order of the lead, s elements are shared only if the first shared one, and
    maybe more, has t - 1 or more after it in either line. So the join makes no row where either line has fewer left, and the lead's own text, which many lines lack alike and which comes last, joins none of them.
    The pairs that meet are few then, and s, and with it their exact likeness, is had from their lists of differences.
    """
    r = 1 - similarity
    q = r / (2 - r)
    rows = _with_sets(groups, texts)
    more = F.array_except("mine", "its")
    # A shingle that the line lacks is told from one that it adds by its inverted bits.
    less = F.transform(F.array_except("its", "mine"), lambda x: F.bitwise_not(x))
    rows = rows.select(F.col("b").alias("lead"), F.col("a").alias("line"), F.col("part_a").alias("part"), (F.col("part_a") != F.col("part_b")).alias("loose"), F.size("mine").alias("own"), F.size("its").alias("its"), F.concat(more, less).alias("xs"))
    n = F.size("xs")
    least = F.greatest(F.ceil(n - q * F.col("own") * (1 + 1 / (1 - r)) - MARGIN), F.lit(1))
    under = F.greatest(least, F.ceil((n + q * (F.col("its") - F.col("own"))) / 2 - MARGIN))
    rows = rows.select("lead", "line", "part", "loose", "own", "xs", (n - least + 1).cast("int").alias("as_v"), (n - under + 1).cast("int").alias("as_w"))
    taken = F.when(F.col("loose"), F.greatest("as_v", "as_w")).otherwise(F.col("as_w"))
    lines = rows = scratch.keep(rows.where(taken > 0).withColumn("taken", taken), "differences")
    every = rows.select("lead", "line", "part", "loose", "own", "as_v", "as_w", "taken", F.size("xs").alias("n"), F.explode("xs").alias("x"))
    often = scratch.keep(every.groupBy("lead", "x").agg(F.count("*").alias("often")).where("often > 1"), "often")
    # A difference that one line alone has meets nothing, but takes its place in the order.
    order = Window.partitionBy("lead", "line").orderBy(F.coalesce("often", F.lit(1)), "x")
    rows = every.join(often, ["lead", "x"], "left").withColumn("place", F.row_number().over(order) - 1).where("place < taken and often > 1")
    rows = scratch.keep(rows.select("lead", "x", "line", "part", "own", "n", (F.col("n") - F.col("place") - 1).alias("rest"), (F.col("loose") & (F.col("place") < F.col("as_v"))).alias("loose"), (F.col("place") < F.col("as_w")).alias("met")), "firsts")
    scratch.drop("often")
    shared = _meetings(rows, similarity)
    shared = scratch.keep(shared.distinct(), "met")
    for x in ("a", "b"):
        shared = shared.join(lines.select("lead", F.col("line").alias(x), F.col("own").alias(f"own_{x}"), F.col("xs").alias(f"xs_{x}")), ["lead", x])
    own = F.col("own_a") + F.col("own_b")
    common = (own - F.size("xs_a") - F.size("xs_b")) / 2 + F.size(F.array_intersect("xs_a", "xs_b"))
    shared = scratch.keep(shared.where(common >= similarity * (own - common) - MARGIN).select("a", "b").distinct(), "shared")
    scratch.drop("differences", "firsts", "met")
    return shared


def _components(members: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, component) over lines that share a bucket of ``members`` (band, line, n) and are ``similarity`` alike.

    The most frequent line leads a bucket. Each line is held against all its leads. Of a large bucket, what is apart from the lead chooses a new lead among itself, ROUNDS times. Two lines of a bucket
    that are still in different components are compared if the bucket is small; in a larger one they can only be alike if they share enough of their differences from the first lead (see ``_partners``),
    and these are compared. So every pair of a bucket is verified, ruled out, or connected, and links of one family cost comparisons in proportion to its lines.
    """
    parts = _Parts(members.sparkSession, scratch)
    bucket = Window.partitionBy("band")
    top = F.max(F.struct("n", (-F.col("line")).alias("at"))).over(bucket)
    size = F.count("*").over(bucket)
    led = members.withColumn("top", top).withColumn("size", size).select("band", "n", "size", F.col("line").alias("a"), (-F.col("top.at")).alias("b")).where("a <> b")
    led = scratch.keep(led, "led")

    def hold(pairs: DataFrame, name: str) -> bool:
        pairs = scratch.keep(pairs, f"{name}-pairs")
        some = not pairs.isEmpty()
        if some:
            parts.add(scratch.keep(_alike(pairs, texts, similarity), name).where("alike"))
        scratch.drop(f"{name}-pairs", name)
        return some

    def apart(rows: DataFrame) -> DataFrame:
        return _with_parts(rows, parts.now).where("part_a <> part_b").drop("part_a", "part_b")

    if not hold(led.select("a", "b").distinct(), "leads"):
        return parts.now
    left = apart(led.where(F.col("size") > SMALL))
    for k in range(ROUNDS):
        left = scratch.keep(left.select("band", "n", F.col("a").alias("line")), f"left{k}")
        again = left.withColumn("top", top).select("band", "n", F.col("line").alias("a"), (-F.col("top.at")).alias("b")).where("a <> b")
        if not hold(apart(again.select("a", "b").distinct()), f"again{k}"):
            break
        left = apart(again)
        if k:
            scratch.drop(f"left{k - 1}")
    small = _with_parts(led.where(F.col("size") <= SMALL).select("band", "a", "b"), parts.now).select("band", F.col("a").alias("line"), F.col("part_a").alias("part"))
    rest = small.select("band", F.col("line").alias("a"), F.col("part").alias("p")).join(small.withColumnRenamed("line", "b"), "band").where("a < b and p <> part").select("a", "b")
    groups = _with_parts(led.where(F.col("size") > SMALL).select("a", "b").distinct(), parts.now)
    mixed = groups.groupBy("b").agg(F.min("part_a").alias("low"), F.max("part_a").alias("high")).where("low <> high").select("b")
    groups = scratch.keep(groups.join(mixed, "b", "left_semi"), "groups")
    if not groups.isEmpty():
        rest = rest.unionByName(_partners(groups, texts, similarity, scratch))
    hold(rest.distinct(), "rest")
    return parts.now


def line_classes(docs: DataFrame, similarity: float = 0.8, least: int = 20) -> DataFrame:
    """One row for each line of ``docs`` (doc_id, text): doc_id, line_no (from 0), class_id and kept.

    Lines are split at line feeds and compared in lower case without blanks at the ends. Two lines link if the Jaccard likeness of their sets of
    8-character shingles is ``similarity`` or more; equal lines always do. Of the lines that links connect the one with the smallest (doc_id, line_no) is kept;
    class_id is the same for all of them, whatever the order of rows. Lines with fewer than ``least`` characters are kept and have no class. A null text is
    one empty line. A null doc_id counts as larger than all; rows that share a doc_id lose what the first of equal lines has, one of equal
    (doc_id, line_no) rows included: both have the same verdict. Other columns are not read, an empty table gives no rows.

    Lines and shingles are told apart by 64-bit hashes of their normalised texts. Candidates share a band (see the tests for the share of pairs that do, by length). Within a bucket every pair
    that can be alike is verified, connected already or ruled out by a bound (see ``_components``). Equal lines are one entry from the first aggregate on, however many there are.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = scratch.keep(_lines(docs, least).select("doc_id", "row", "line_no", "line"), "lines")
    with setting(docs.sparkSession, BY_ORDER, "true"):
        signed = scratch.keep(_signed(_lines(docs, least)), "signed")
    distinct = scratch.keep(signed.drop("bands"), "distinct")
    crowd = F.count("*").over(Window.partitionBy("band"))
    members = signed.select("line", F.explode("bands").alias("band")).withColumn("size", crowd).where("size > 1").select("band", "line")
    members = scratch.keep(members.join(distinct.select("line", "n"), "line").select("band", "line", "n"), "members")
    scratch.drop("signed")
    # Texts of the lines in these buckets, from the document that has each first.
    wanted = _few(members.select("line").distinct().join(distinct, "line").select("line", F.col("min_doc").alias("of")), scratch, "wanted", MOST_TEXTS)
    texts = scratch.keep(_texts(docs, lines, wanted, scratch), "texts")
    parts = _components(members, texts, similarity, scratch)
    scratch.drop("members", "wanted", "places", "texts", "led", "groups", "shared")
    # Only lines with links have classes of several; the others lead their own.
    linked = scratch.keep(distinct.join(parts.withColumnRenamed("node", "line"), "line"), "linked")
    heads = linked.groupBy("component").agg(F.min("min_doc").alias("head"), F.sum("n").alias("sum"))
    linked = scratch.keep(linked.select("line", "component").join(heads, "component"), "heads")
    of = distinct.join(linked, "line", "left")
    alone = F.col("component").isNull()
    of = of.select("line", F.coalesce("component", "line").alias("class_id"), F.when(alone, F.col("min_doc")).otherwise(F.col("head")).alias("head"), F.when(alone, F.col("n")).otherwise(F.col("sum")).alias("total"))
    of = scratch.keep(of, "classes")
    scratch.drop("distinct", "linked", "heads")
    found = lines.where("line is not null").join(of, "line")
    first = F.min("line_no").over(Window.partitionBy("doc_id", "class_id"))
    inside = found.where("total > 1 and doc_id <=> head").withColumn("kept", F.col("line_no") == first).select("doc_id", "line_no", "class_id", "kept")
    outside = found.where("total = 1 or not doc_id <=> head").select("doc_id", "line_no", "class_id", (F.col("total") == 1).alias("kept"))
    short = lines.where("line is null").select("doc_id", "line_no", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return inside.unionByName(outside).unionByName(short)


def without_repeats(docs: DataFrame, similarity: float = 0.8, least: int = 20) -> DataFrame:
    """``docs`` with the kept lines only, joined by line feeds; n_chars, if it is a column, follows.

    Documents of which no line but blank ones is left, though something was removed, are left out. Documents that lose nothing stay as they are, a null text among them.
    Rows that share a doc_id, null included, lose the lines that a verdict on any of them names. All columns come through, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    verdicts = line_classes(docs, similarity, least).where("not kept").select("doc_id", "line_no").distinct()
    of, gone, left = unused(docs, "of"), unused(docs, "gone"), unused(docs, "left")
    removed = scratch.keep(verdicts.groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("line_no").alias(gone)), "removed", small=True)
    few = removed.limit(MOST_BROADCAST // 4 + 1).count() <= MOST_BROADCAST // 4 and not removed.where(F.size(gone) > MOST_LINES).limit(1).count()
    rows = docs.join(F.broadcast(removed) if few else removed, F.col("doc_id").cast("long").eqNullSafe(F.col(of)), "left")
    rows = rows.withColumn(left, F.when(F.col(gone).isNotNull(), F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))))
    rows = rows.where(F.col(gone).isNull() | F.exists(left, lambda x: x.rlike("\\S")))
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
