"""Registered queries of the training-data operators: each applies one operator with production
parameters to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import byte_bpe, chat, common, dac, embedding_dedup, hard_negatives, importance, language_id, ngram_join, oracle, packing, quality, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


@register("op1_token_id_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.run_dir(spark, "op1")
    manifest = dac.write_ids(common.table(spark, sf_dir, "documents"), out, public_tokenizers.path(WORD_BPE))
    return dac.read_ids(manifest, out)


@register("op2_warc", oracle.WARC)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.run_dir(spark, "op2")
    warc.write_warc(common.table(spark, sf_dir, "pages"), out)
    return warc.read_warc(spark, out)


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@register("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE),
                                  public_tokenizers.PATTERN)


@register("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@register("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@register("op7_chat_format", oracle.CHAT)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = common.run_dir(spark, "op7")
    chat.write_chats(rows, out)
    return chat.read_chats(spark, out)


@register("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


@register("op9_embedding_dedup", oracle.EMBEDDINGS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(common.table(spark, sf_dir, "embeddings"))


@register("op10_ngram_join", oracle.NGRAMS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(common.table(spark, sf_dir, "documents"))


@register("op11_hard_negatives", oracle.HARD_NEGATIVES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


@register("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


@register("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_id.identify(common.table(spark, sf_dir, "documents"), held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "code_bits")
