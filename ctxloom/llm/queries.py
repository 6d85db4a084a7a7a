"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import graph_index, lines, lm, mixing, order_minhash, packing, passages, simhash, tokens, toxicity
from ctxloom.llm.shared import remainder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return graph_index.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, passages="passages")
    held = F.coalesce(remainder("doc_id", 5), F.lit(0)) == 0  # no label teaches anything for a null id
    return found.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits on every document: a deletion after a quarter, an insertion in the middle, another end."""
    n = F.char_length(F.coalesce("text", F.lit("")))

    def edit(start, stop, replacement: str):
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(replacement).alias("replacement"))

    edits = F.array(edit(F.floor(n / 4), F.floor(n / 4) + 7, ""), edit(F.floor(n / 2), F.floor(n / 2), " a corrected line\n"), edit(n, n + 64, "end of text."))
    found = tokens.count_edits(_table(spark, sf_dir, "documents"), TOKENIZER, edits)
    return found.select("doc_id", "n_tokens", "n_pieces", "edited_tokens", "n_encoded", F.sha2("edited_text", 256).alias("edited_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 10), F.lit(0)) == 0
    return lm.score_corpus(_table(spark, sf_dir, "documents")).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprint_edits(_table(spark, sf_dir, "documents"))
    text = order_minhash.as_text
    return found.select("doc_id", "n_chars", "edited_sha256", text(F.col("signature")).alias("fingerprint"), text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "n_tokens", "epoch", "block", "block_key", "doc_key", F.round("weight", 9).alias("weight"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(passages.repeated_passages(_table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict:
    return {"op1_graph_ann": op1_graph_ann, "op2_best_fit_packing": op2_best_fit_packing, "op3_line_dedup": op3_line_dedup, "op4_toxicity": op4_toxicity, "op5_lm_scoring": op5_lm_scoring, "op6_token_counts": op6_token_counts, "op7_order_minhash": op7_order_minhash, "op8_source_mixing": op8_source_mixing, "op9_suffix_dedup": op9_suffix_dedup, "op10_simhash": op10_simhash}


def oracle_sql() -> dict[str, str]:
    return {}
