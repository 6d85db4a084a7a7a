"""How far an index is behind its sources, the extraction cache, and reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drift_rows(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """(repo, path, state) of files that are added, removed or changed between ``indexed`` and ``present`` (repo, path, content_hash, mtime, bytes).

    Equal time (in seconds) and size (if the index has one) mean unchanged; else the hashes decide. Repositories that are in one side only do not count.
    """
    i = indexed.select("repo", "path", F.col("content_hash").alias("h0"), F.col("mtime").alias("m0"), F.col("bytes").alias("b0"), F.lit(True).alias("old"))
    p = present.select("repo", "path", F.col("content_hash").alias("h1"), F.col("mtime").alias("m1"), F.col("bytes").alias("b1"), F.lit(True).alias("new"))
    both = i.join(p, ["repo", "path"], "full_outer")
    same = (F.col("m0") == F.col("m1")) & (F.col("b0").isNull() | (F.col("b0") == F.col("b1"))) | (F.col("h0") == F.col("h1"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.coalesce(same, F.lit(False)), "changed")
    return both.select("repo", "path", state.alias("state")).where("state is not null")


def drift(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """One row: changed, added, removed, indexed."""
    rows = drift_rows(indexed, present)
    counts = rows.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("changed", "added", "removed")))
    return counts.crossJoin(F.broadcast(indexed.agg(F.count("*").alias("indexed"))))  # one row each


def drift_summary(row: dict) -> str:
    return ", ".join(f"{row[k]} {k}" for k in ("changed", "added", "removed") if row[k]) or "up to date"


class Throttle:
    """Keeps a measurement for ``seconds``; a failure counts as no measurement."""

    def __init__(self, measure: Callable[[], dict], seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.measure, self.seconds, self.clock, self.at, self.value = measure, seconds, clock, None, None

    def get(self) -> dict | None:
        now = self.clock()
        if self.at is None or now - self.at >= self.seconds:
            self.at = now
            try:
                self.value = self.measure()
            except Exception:
                self.value = None
        return self.value

    def forget(self) -> None:
        """The next question measures anew."""
        self.at = None


def with_stale_note(answer: dict, row: dict | None) -> dict:
    behind = row and any(row[k] for k in ("changed", "added", "removed"))
    return answer | {"stale_index": f"the index is behind: {drift_summary(row)}"} if behind else answer


def cache_lookup(scan: DataFrame, cache: DataFrame, now: int, keys: tuple[str, ...] = ("content_hash", "lang")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits with payload, misses, the cache with the hits' time renewed) of ``scan`` (content_hash, lang, ...) by ``keys``."""
    keys = list(keys)
    hits = scan.join(cache.select(*keys, "payload"), keys)
    misses = scan.join(cache.select(*keys), keys, "left_anti")
    used = scan.select(*keys).distinct().withColumn("__hit", F.lit(True))
    renewed = cache.join(used, keys, "left").withColumn("used_at", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("used_at"))).drop("__hit")
    return hits, misses, renewed


def cache_put(cache: DataFrame, fresh: DataFrame, now: int, keys: tuple[str, ...] = ("content_hash", "lang")) -> DataFrame:
    """``cache`` with an entry for each distinct key of ``fresh`` (keys, payload) that it lacks."""
    rows = fresh.join(cache.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    sized = rows.select(*keys, "payload", F.octet_length(F.to_json("payload")).cast("long").alias("bytes"), F.lit(now).cast("long").alias("used_at"))
    return cache.unionByName(sized)


def cache_evict(cache: DataFrame, most_bytes: int) -> DataFrame:
    """The cache without its oldest quarter if it is larger than ``most_bytes``, else as it is."""
    total, n = cache.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    if total <= most_bytes:
        return cache
    quarter = cache.orderBy("used_at", "content_hash", "lang").limit(n // 4).select("content_hash", "lang")
    return cache.join(quarter, ["content_hash", "lang"], "left_anti")


def hit_rate(hits: int, misses: int) -> float:
    return hits / (hits + misses) if hits + misses else 0.0


def files_by_language(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'file'").groupBy(F.coalesce("lang", F.lit("(unknown)")).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


def language_coverage(files: DataFrame) -> DataFrame:
    """(lang, files, parsed, mark) of parsed files: 99 of 100 without an error are good, 90 are fair."""
    g = files.groupBy("lang").agg(F.count("*").alias("files"), F.count_if(~F.col("had_parse_error")).alias("parsed"))
    share = F.col("parsed") / F.col("files")
    return g.withColumn("mark", F.when(share >= 0.99, "good").when(share >= 0.9, "fair").otherwise("poor"))


def bench_summary(results: DataFrame) -> DataFrame:
    """Means over tasks (task, packed, plain, expected array, refs array): tokens in whole numbers, saving, recall of the tasks that expect something."""
    hit = F.size(F.filter("expected", lambda e: F.exists("refs", lambda r: F.contains(r, e))))
    rows = results.withColumn("recall", F.when(F.size("expected") > 0, hit / F.size("expected"))).withColumn("saving", F.when(F.col("plain") > 0, 1 - F.col("packed") / F.col("plain")).otherwise(F.lit(0.0)))
    return rows.agg(F.floor(F.avg("packed")).cast("long").alias("packed"), F.floor(F.avg("plain")).cast("long").alias("plain"), F.avg("saving").alias("saving"), F.avg("recall").alias("recall"))


def top_per_group(rows: DataFrame, group: str, order, k: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= k).drop("__r")
