"""Helpers that several training-data operators share: durable intermediates, hashing and token rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: U+0020 and U+0009 to U+000D.
BLANK = "[\\x20\\x09-\\x0D]+"
#: Spark's switch that removes a query's shuffle files when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Scratch objects made inside each open ``temporary`` block.
_MADE: list[list[Scratch]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Spark takes that setting only when a session starts. A session without it has no folder that is known to be shared, so this raises an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share when the session is built; operators write their intermediate tables there")
    return folder.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    known = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in known:
        name += "_"
    return name


@contextmanager
def temporary() -> Iterator[None]:
    """Removes the tables that operators write inside the block once it ends: whatever reads them must be written by then."""
    _MADE.append([])
    try:
        yield
    finally:
        for scratch in _MADE.pop():
            scratch.drop("")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """One of Spark's switches (off unless set), held at ``value`` for what is run inside the block."""
    before = spark.conf.get(key, "false")
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written into the shared folder: they cut lineage and outlive lost executors.

    ``keep`` writes a DataFrame and returns it as read back; ``drop`` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if _MADE:
            _MADE[-1].append(self)

    def keep(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """Writes ``df``; ``small`` deals its rows anew into as few files as their bytes need, where the work before has many tasks and few rows."""
        df = df.hint("rebalance") if small else df
        path = f"{self.root}/{name}"
        with setting(self.spark, FREE_SHUFFLES, "true"):  # what the write shuffled isn't read again once the table stands
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``: the rule that assigns folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(of)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
