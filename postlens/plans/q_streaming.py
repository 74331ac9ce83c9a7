"""Catalogue: Structured Streaming ingest and weekly counts, compared with the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.plans.registry import register
from postlens.sources.keyed_table import KeyedTable
from postlens.sources.tables import EVENTS_POSTS_SQL, event_sentiment
from postlens.streaming import ingest as ST


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    return raw.select(
        F.col("event_id").cast("string").alias("tweet_id"), F.col("ts").alias("time"),
        F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("content"),
        event_sentiment(F.col("event_type")).alias("sentiment"),
        (F.col("value") >= 1.0).alias("relevant"))


@register("ingest_stream", f"""
WITH p AS ({EVENTS_POSTS_SQL})
SELECT tweet_id, time, author, content, sentiment, relevant FROM p WHERE length(content) > 0
""")
def ingest_stream(spark, sf_dir):
    """Events as a file stream → non-empty posts → insert-if-new into a post table."""
    table_path = ST.scratch_path(spark, "posts")
    stream = _event_stream(spark, sf_dir).where(F.length("content") > 0)
    q = ST.ingest_stream(spark, stream, table_path, ST.scratch_path(spark, "ingest-ckpt"))
    q.awaitTermination()
    return KeyedTable(spark, table_path).read()


@register("weekly_stream", f"""
WITH p AS ({EVENTS_POSTS_SQL}),
wk AS (
  SELECT CAST(date_trunc('week', time) AS DATE) + 6 AS week_end,
         count(CASE WHEN sentiment = 0 THEN 1 END) AS count_neg,
         count(CASE WHEN sentiment = 1 THEN 1 END) AS count_neu,
         count(CASE WHEN sentiment = 2 THEN 1 END) AS count_pos
  FROM p WHERE relevant GROUP BY 1),
s AS (SELECT *, count_neg + count_neu + count_pos AS relevant FROM wk),
t AS (SELECT *, CASE WHEN relevant > 0 THEN (count_pos - count_neg) / relevant ELSE 0.0 END AS sentiment_score,
             relevant / (relevant + 500.0) AS trust_factor FROM s)
SELECT *, sentiment_score * trust_factor AS weighted_sentiment FROM t
""")
def weekly_stream(spark, sf_dir):
    """The weekly sentiment counts maintained by a streaming aggregation."""
    stream = _event_stream(spark, sf_dir).where(F.col("relevant"))
    return ST.run_weekly_stream(spark, stream)


V2_TS = "2024-06-01 00:00:00"


@register("ingest_v2", f"""
WITH r AS (
  SELECT CAST(event_id AS VARCHAR) AS tweet_id, CAST(user_id AS VARCHAR) AS author,
         CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '{V2_TS}'
              WHEN event_id % 500 = 1 THEN ts - INTERVAL 20 YEAR ELSE ts END AS time,
         CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS content,
         CAST(event_id % 3 AS BIGINT) AS comment_count, CAST(event_id % 100 AS BIGINT) AS like_count,
         CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 10 END AS BIGINT) AS repost_count,
         CAST(0 AS BIGINT) AS view_count, TIMESTAMP '{V2_TS}' AS created_at
  FROM events)
SELECT * FROM r WHERE length(content) > 0
""")
def ingest_v2(spark, sf_dir):
    """Raw v2 items as a stream of JSON files — mentions, empty posts, bad times,
    posts twenty years old, a file with repeated items — cleaned and inserted if new."""
    from postlens.sources import ingest as IN
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, ts = F.col("event_id"), F.col("ts")
    iso = F.date_format(F.when(i % 500 == 1, ts - F.expr("INTERVAL 20 YEARS")).otherwise(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = ev.select(
        i.cast("string").alias("id"), F.col("user_id").cast("string").alias("author"),
        F.when(i % 11 == 0, "DATEUNDEFINED").otherwise(iso).alias("time"),
        F.concat(F.lit("@user "), F.when(i % 13 == 0, "").otherwise(F.col("event_type"))).alias("content"),
        F.struct((i % 3).cast("double").alias("replies"), F.when(i % 7 != 0, (i % 10).cast("double")).alias("retweets"),
                 (i % 100).cast("double").alias("likes")).alias("engagement"))
    path = ST.scratch_path(spark, "raw-v2")
    raw.write.json(path)
    raw.where(i % 50 == 0).write.mode("append").json(path)            # items crawled twice
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 4).json(path)
    clean = IN.clean_v2(stream, F.lit(V2_TS).cast("timestamp_ntz"))
    table_path = ST.scratch_path(spark, "posts-v2")
    ST.ingest_stream(spark, clean, table_path, ST.scratch_path(spark, "ingest-v2-ckpt")).awaitTermination()
    return KeyedTable(spark, table_path).read()
