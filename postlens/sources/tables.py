"""Readers for the driver's parquet tables and the two post mappings used by the catalogue.

``posts_from_events``    – timed posts: one row per event, sentiment derived from the event type.
``posts_from_documents`` – post text: documents decorated with RT prefixes, mentions, URLs,
                           hashtags, year-letter runs, ``dari`` domains and quote cuts, because the
                           raw prose holds none of the marks the cleaners look for.

Both are plain projections, so Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_sentiment(event_type: Column) -> Column:
    """Map event types onto the three sentiment classes (0 negative, 1 neutral, 2 positive)."""
    return (F.when(event_type == "error", F.lit(0))
            .when(event_type.isin("view", "click"), F.lit(1))
            .when(event_type.isin("purchase", "signup"), F.lit(2))
            .otherwise(F.lit(-1)))


def posts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → posts(tweet_id, time, author, content, sentiment, relevant, value)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("string").alias("tweet_id"),
        F.col("ts").alias("time"),
        F.col("user_id").cast("string").alias("author"),
        F.col("event_type").alias("content"),
        event_sentiment(F.col("event_type")).alias("sentiment"),
        (F.col("value") >= F.lit(1.0)).alias("relevant"),
        F.col("value"),
    )


EVENTS_POSTS_SQL = """
SELECT CAST(event_id AS VARCHAR) AS tweet_id, ts AS time, CAST(user_id AS VARCHAR) AS author,
       event_type AS content,
       CASE WHEN event_type = 'error' THEN 0
            WHEN event_type IN ('view', 'click') THEN 1
            WHEN event_type IN ('purchase', 'signup') THEN 2 ELSE -1 END AS sentiment,
       value >= 1.0 AS relevant, value
FROM events
"""


def _s(c: Column) -> Column:
    return c.cast("string")


def decorate_text(doc_id: Column, text: Column) -> Column:
    """The decoration rule of the ``posts`` view (same expression as POSTS_SQL)."""
    d = doc_id
    return F.concat(
        F.when(d % 7 == 0, F.lit("RT ")).otherwise(F.lit("")),
        F.when(d % 3 == 0, F.concat(F.lit("@user"), _s(d % 97), F.lit(" "))).otherwise(F.lit("")),
        text,
        F.when(d % 4 == 0, F.concat(F.lit(" https://ex.example/"), _s(d))).otherwise(F.lit("")),
        F.concat(F.lit(" #Topic"), _s(d % 13)),
        F.when(d % 5 == 0, F.concat(F.lit(" #tag_"), _s(d % 5), _s(d % 11))).otherwise(F.lit("")),
        F.when(d % 6 == 0, F.lit(" 2025an wooow!!!")).otherwise(F.lit("")),
        F.when(d % 10 == 0, F.lit(" negaradari berita.example.com")).otherwise(F.lit("")),
        F.when(d % 9 == 0, F.lit(" Kutipan lama")).otherwise(F.lit("")),
    )


def posts_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → posts(tweet_id BIGINT, content, author, lang)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("tweet_id"),
        decorate_text(F.col("doc_id"), F.col("text")).alias("content"),
        F.col("source").alias("author"),
        F.col("lang"),
    )


POSTS_SQL = """
SELECT doc_id AS tweet_id,
       concat(
         CASE WHEN doc_id % 7 = 0 THEN 'RT ' ELSE '' END,
         CASE WHEN doc_id % 3 = 0 THEN concat('@user', CAST(doc_id % 97 AS VARCHAR(10)), ' ') ELSE '' END,
         text,
         CASE WHEN doc_id % 4 = 0 THEN concat(' https://ex.example/', CAST(doc_id AS VARCHAR(20))) ELSE '' END,
         concat(' #Topic', CAST(doc_id % 13 AS VARCHAR(10))),
         CASE WHEN doc_id % 5 = 0 THEN concat(' #tag_', CAST(doc_id % 5 AS VARCHAR(10)), CAST(doc_id % 11 AS VARCHAR(10))) ELSE '' END,
         CASE WHEN doc_id % 6 = 0 THEN ' 2025an wooow!!!' ELSE '' END,
         CASE WHEN doc_id % 10 = 0 THEN ' negaradari berita.example.com' ELSE '' END,
         CASE WHEN doc_id % 9 = 0 THEN ' Kutipan lama' ELSE '' END) AS content,
       source AS author, lang
FROM documents
"""
