"""The corpus pipeline: toxic documents go, documents of bad quality go, one document of each group of
near duplicates stays, and the rest is packed into training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes every stage's result as Parquet below ``spark.checkpoint.dir`` and reads
it back as the next stage's input, so a lost executor repeats one stage's tasks only.

Null ids and texts, repeated rows, empty tables and extra columns are treated as the operators'
docstrings say; a stage passes extra columns on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postlens.llm import common, ngram_join, packing, quality, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3.  The lexicon is learned from the labelled documents that are there."""
    model = toxicity.fit_toxicity(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5."""
    return quality.keep_good(docs)


def reject_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10."""
    return ngram_join.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("near_duplicates", reject_near_duplicates),
    ("packing", pack_sequences),
]

#: Learned weights, estimated accuracies and token ids are not SQL; the stages are tested against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = common.table(spark, sf_dir, "documents"), common.run_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}-{name}")
        docs = spark.read.parquet(f"{out}/{k}-{name}")
    return docs
