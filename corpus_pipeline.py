"""The corpus pipeline: five stages over documents, each one operator of ctxloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of ``documents``. The order is fixed: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources are
mixed to tempered weights, and what is left is packed into training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import lines, mixing, packing, simhash, toxicity
from ctxloom.llm.shared import Scratch, temporary, unused

#: Ids that are broadcast (one number each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below 0.5; the model learns from the labels and this stage's own input.

    Each row is judged by its own text, whatever its doc_id, null or repeated; null and empty texts have no segment and stay. Without labels of both kinds nothing goes. An empty table stays empty.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = unused(docs, "toxicity")
    return toxicity.score(docs, model, into=into).where(F.col(into) < 0.5).drop(into)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line kept of each class of near-equal lines; those that lose lines and have none but blank ones left go.

    A null text loses nothing. Rows that repeat a doc_id count as one document; a null doc_id counts as larger than all. An empty table stays empty.
    """
    return lines.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links connect (four-word shingles, four bits), the document with the smallest doc_id.

    Documents without a word, null texts among them, share the fingerprint 0 and so are one group. Rows that repeat a doc_id stay or go together; rows with a null doc_id stay.
    The ids that go are broadcast while they are few, so that texts are not shuffled for them. An empty table stays empty.
    """
    scratch = Scratch(spark, "near-duplicates")
    found = simhash.near_duplicates(docs).where("doc_id is not null and component_id is not null")
    gone_id = unused(docs, "gone")
    gone = found.groupBy(F.col("doc_id").alias(gone_id)).agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept")).where("not kept").select(gone_id)
    gone = scratch.keep(gone, "gone", small=True)
    few = gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources have tempered weights: each at least once, none more than twice as often as its weight needs.

    A null source is a source of its own name, ''; null texts have no tokens and are read once. Rows that repeat a doc_id, null included, are drawn together. An empty table stays empty.
    """
    return mixing.mixed_documents(docs, most_repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences of at most 2048.

    A null text is the empty text, one token; rows that repeat are packed as often as they come, a null doc_id stays null. An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned scores, signatures and tokenisation are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, as the next one's input.

    A stage's own tables go once its result stands, and so does a result once the next one does.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with temporary():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[last][1](spark, docs, sf_dir)
