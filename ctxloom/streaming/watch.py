"""Changes over time: debounced events, and refreshing an index from a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, at: str, keys: list[str], quiet: str = "500 milliseconds") -> DataFrame:
    """``keys``, started, ended and n of bursts of events with less than ``quiet`` between them. Works on streams with a watermark, too."""
    w = F.session_window(at, quiet)
    return events.groupBy(*keys, w).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n")).drop("session_window")


IGNORED = r"(^|/)(\.git|\.ctxloom)(/|$)"


def changed_paths(batch: DataFrame) -> DataFrame:
    """Distinct paths of a batch of change events (path), without those of the index's and git's own folders."""
    return batch.where(~F.col("path").rlike(IGNORED)).select("path").distinct()


def watch(changes: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = "500 milliseconds"):
    """Starts a query that hands the paths of each micro-batch of ``changes`` (a stream with path) to ``refresh``.

    A batch that is run again after a failure has the same number, so a refresh that writes by it is exactly-once.
    """

    def one(batch: DataFrame, number: int) -> None:
        paths = changed_paths(batch)
        if not paths.isEmpty():
            refresh(paths, number)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
