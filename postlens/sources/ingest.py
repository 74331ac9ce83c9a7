"""Sources and sinks.

Raw posts arrive as JSON (crawler dumps, extended-JSON database exports) or as crawled HTML
pages; they are read with explicit schemas, normalised, cleaned with native expressions, and
appended to a post table keyed by ``tweet_id`` with insert-if-new semantics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import text as TX
from postlens.functions.parse import parse_km, parse_metrics
from postlens.operators.sampling import dedup_first
from postlens.sources.text_files import write_text_files

# ---------------------------------------------------------------- schemas

_DATE = T.StructType([T.StructField("$date", T.StringType())])
RAW_DUMP_SCHEMA = T.StructType([
    T.StructField("_id", T.StructType([T.StructField("$oid", T.StringType())])),
    T.StructField("tweet_id", T.StringType()), T.StructField("time", _DATE),
    T.StructField("author", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("comment_count", T.LongType()), T.StructField("repost_count", T.LongType()),
    T.StructField("like_count", T.LongType()), T.StructField("view_count", T.LongType()),
    T.StructField("created_at", _DATE), T.StructField("__v", T.IntegerType())])

RAW_POST_V2_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("time", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("engagement", T.StructType([
        T.StructField("replies", T.DoubleType()), T.StructField("retweets", T.DoubleType()),
        T.StructField("likes", T.DoubleType())]))])

RAW_POST_V1_SCHEMA = T.StructType([
    T.StructField("author", T.StringType()), T.StructField("time", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("data", T.StringType())])

POST_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.StringType(), False), T.StructField("time", T.TimestampNTZType()),
    T.StructField("author", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("comment_count", T.LongType()), T.StructField("repost_count", T.LongType()),
    T.StructField("like_count", T.LongType()), T.StructField("view_count", T.LongType())])


# ---------------------------------------------------------------- A1, A2, A3, A7, A9

def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A2: a JSON file holding one array of records (or JSON lines when ``multiLine`` is not
    needed).  Always pass a schema in production; inference is for ad-hoc files only."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def _is_date_struct(dt: T.DataType) -> bool:
    return isinstance(dt, T.StructType) and [f.name for f in dt.fields] == ["$date"]


def normalize_posts(df: DataFrame, drop=("_id", "__v", "created_at")) -> DataFrame:
    """A1: drop the database bookkeeping fields; every ``{"$date": x}`` becomes ``x`` without
    its trailing ``Z`` characters; all other fields unchanged."""
    out = df.drop(*[c for c in drop if c in df.columns])
    for f in out.schema.fields:
        if _is_date_struct(f.dataType):
            out = out.withColumn(f.name, F.regexp_replace(F.col(f.name).getField("$date"), "Z+$", ""))
    return out


def write_split(df: DataFrame, root: str, split: str, mode: str = "overwrite") -> None:
    """A3: publish a named split as Parquet under ``root/split=<name>``."""
    df.write.mode(mode).parquet(f"{root.rstrip('/')}/split={split}")


def write_posts_by_month(df: DataFrame, root: str, time_col: str = "time", mode: str = "append") -> None:
    """Store posts partitioned by month (``month=YYYY-MM``) so time-range queries (B6, F2) read
    only the months they need (partition pruning), sorted by time inside each file so Parquet
    row-group statistics skip the rest."""
    out = df.withColumn("month", F.date_format(F.col(time_col), "yyyy-MM"))
    (out.repartition("month").sortWithinPartitions(time_col)
     .write.mode(mode).partitionBy("month").parquet(root))


def read_split(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """A3: one split, or all splits with a ``split`` column (partition pruning on ``split``)."""
    if split is None:
        return spark.read.parquet(root)
    return spark.read.parquet(f"{root.rstrip('/')}/split={split}")


def write_labelled_dir(df: DataFrame, root: str) -> None:
    """Every row of ``df`` (``folder``, ``text``) as a text file of its own under its folder; the text ends with a
    line end, a null text is that line end.  On a mounted (``file:``) folder each task writes its files itself
    (``text_files``), elsewhere Spark's text sink does; both put the files of a task below folders of that task, which
    a commit moves as a whole."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    out = df.select("folder", F.col("text").cast("string").alias("text"))
    if uri.getScheme() == "file":
        write_text_files(out, uri.getPath())
    else:
        (out.withColumn("task", F.spark_partition_id()).write.option("maxRecordsPerFile", 1)
         .partitionBy("task", "folder").text(root))


#: Endings of compressed files that Spark's text source unpacks.
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst")


def read_labelled_dir(spark: SparkSession, root: str, labels=(("pos", 1), ("neg", 0))) -> DataFrame:
    """Every text file under ``pos/`` → label 1, ``neg/`` → 0 (also ``<key>=pos/`` folders
    as Spark writes them); other folders skipped.  One row per file.

    The files are small, so what counts is the cost per file: they come as bytes (the text source copies a Hadoop
    configuration for each), many to a task (the scan alone takes 32); only compressed files are read as text."""
    path = F.col("_metadata.file_path").alias("path")
    files = spark.read.option("recursiveFileLookup", True)
    plain = (files.format("binaryFile").load(root).select(F.col("content").cast("string").alias("text"), path)
             .where(~F.lower("path").rlike(rf"\.({'|'.join(PACKED)})$")))
    any_case = ("".join(f"[{c}{c.upper()}]" for c in ending) for ending in PACKED)
    packed = (files.option("pathGlobFilter", f"*.{{{','.join(any_case)}}}").text(root, wholetext=True)
              .select(F.col("value").alias("text"), path))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    df = plain.coalesce(tasks).union(packed)
    names = "|".join(re.escape(n) for n, _ in labels)
    folder = F.regexp_extract(F.col("path"), f"/(?:[^/=]*=)?({names})/[^/]*$", 1)
    label = None
    for name, value in labels:
        label = (F.when(folder == name, F.lit(value)) if label is None
                 else label.when(folder == name, F.lit(value)))
    return df.withColumn("label", label).where(F.col("label").isNotNull()).select("text", "label", "path")


def write_lines(df: DataFrame, path: str, col: str = "content") -> None:
    """One text line per row (newlines inside a value are kept as they are)."""
    df.select(F.col(col).cast("string")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- A11: validation

REQUIRED_V1 = ("time", "author", "content", "data")


def validate_posts(df: DataFrame, required=REQUIRED_V1, mode: str = "row", batch_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every item needs the ``required`` string fields.  Returns (valid, rejected with a
    ``reason``).  ``mode='all'`` rejects the whole batch when one item is invalid (the
    reference's behaviour) — with ``batch_col`` each of its values is a batch; ``mode='row'`` rejects
    only the bad items."""
    missing = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    x = df.withColumn("_missing", missing)
    bad = F.size("_missing") > 0
    reason = F.concat(F.lit("missing or not a string: "), F.array_join("_missing", ", "))
    if mode == "row":
        return (x.where(~bad).drop("_missing"),
                x.where(bad).withColumn("reason", reason).drop("_missing"))
    if mode != "all":
        raise ValueError(f"unknown validation mode {mode!r}")
    if batch_col is None:
        n_bad = x.agg(F.count(F.when(bad, 1)).alias("_n_bad")).withColumn("_k", F.lit(1))
        y = x.withColumn("_k", F.lit(1)).join(F.broadcast(n_bad), "_k").drop("_k")       # one row
    else:
        n_bad = x.where(bad).groupBy(F.col(batch_col).alias("_k")).agg(F.count(F.lit(1)).alias("_n_bad"))
        y = x.join(n_bad, F.col(batch_col).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn("_n_bad", F.coalesce("_n_bad", F.lit(0)))
    valid = y.where(F.col("_n_bad") == 0).drop("_missing", "_n_bad")
    rejected = (y.where(F.col("_n_bad") > 0)
                .withColumn("reason", F.when(bad, reason).otherwise(F.lit("batch rejected")))
                .drop("_missing", "_n_bad"))
    return valid, rejected


# ---------------------------------------------------------------- cleaning of raw posts

def clean_v2(raw: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """S1/B4/C5/C21 (v2 crawler): mentions stripped, empty posts dropped, bad times → ingest
    time, replies/likes/retweets from the engagement struct (NaN/NULL → 0), view count 0,
    ``created_at`` = ingest time (B7)."""
    content = TX.strip_mentions(F.col("content"))
    eng = F.col("engagement")
    out = raw.select(
        F.col("id").alias("tweet_id"), F.col("author"),
        TX.parse_time_or(F.col("time"), ingest_ts).alias("time"),
        content.alias("content"),
        F.coalesce(F.nanvl(eng["replies"], F.lit(None)), F.lit(0.0)).cast("long").alias("comment_count"),
        F.coalesce(F.nanvl(eng["likes"], F.lit(None)), F.lit(0.0)).cast("long").alias("like_count"),
        F.coalesce(F.nanvl(eng["retweets"], F.lit(None)), F.lit(0.0)).cast("long").alias("repost_count"),
        F.lit(0).cast("long").alias("view_count"),
        (F.current_timestamp() if ingest_ts is None else ingest_ts).alias("created_at"))
    return out.where(F.length("content") > 0)


def clean_v1(raw: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """B4/C15/C21 (v1 API): mentions stripped; empty posts and posts with fewer than four
    space-separated pieces dropped; engagement parsed from the human-readable string."""
    content = TX.strip_mentions(F.col("content"))
    m = parse_metrics(F.col("data"))
    out = raw.select(
        F.col("author"), TX.parse_time_or(F.col("time"), ingest_ts).alias("time"),
        content.alias("content"),
        F.coalesce(m["replies"], F.lit(0)).alias("comment_count"),
        F.coalesce(m["likes"], F.lit(0)).alias("like_count"),
        F.coalesce(m["retweets"], F.lit(0)).alias("repost_count"),
        F.coalesce(m["views"], F.lit(0)).alias("view_count"))
    return min_content(out, "content", min_words=4)


def min_content(df: DataFrame, col: str = "content", min_words: int | None = None) -> DataFrame:
    """Drop empty texts; optionally those with fewer than ``min_words`` pieces when split on
    single spaces (empty pieces count, as with JavaScript ``split(" ")``)."""
    c = F.col(col)
    out = df.where(c.isNotNull() & (F.length(c) > 0))
    if min_words:
        out = out.where(F.size(F.split(c, " ", -1)) >= min_words)
    return out


# ---------------------------------------------------------------- A8: insert-if-new sink

def insert_new(existing_keys: DataFrame, batch: DataFrame, key: str = "tweet_id",
               order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``batch`` to append to a table with a unique ``key``: duplicates inside the
    batch keep their first row (by ``order_col``, else by the other columns), keys already stored
    are rejected.  Returns (rows to insert, one-row report ``pushed``/``failed``)."""
    first = dedup_first(batch, key, order_col or [c for c in batch.columns if c != key][0])
    fresh = first.join(existing_keys.select(key), key, "left_anti")
    total = batch.agg(F.count(F.lit(1)).alias("batch_rows")).withColumn("_k", F.lit(1))
    pushed = fresh.agg(F.count(F.lit(1)).alias("pushed")).withColumn("_k", F.lit(1))
    report = total.join(pushed, "_k").select(
        "pushed", (F.col("batch_rows") - F.col("pushed")).alias("failed"))
    return fresh, report


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a path exist in its (Hadoop) file system?"""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_new(spark: SparkSession, table_path: str, batch: DataFrame, key: str = "tweet_id",
               order_col: str | None = None) -> DataFrame:
    """A8 sink: append the new rows of ``batch`` to the Parquet table at ``table_path`` (created
    when absent) and return the report."""
    if path_exists(spark, table_path):                  # any other failure to read is an error
        existing = spark.read.parquet(table_path).select(key)
    else:
        existing = spark.createDataFrame([], batch.select(key).schema)
    fresh, report = insert_new(existing, batch, key, order_col)
    fresh = fresh.cache()                               # used by the report and the write
    report_rows = report.collect()                      # one row
    fresh.write.mode("append").parquet(table_path)
    fresh.unpersist()
    return spark.createDataFrame(report_rows, report.schema)


# ---------------------------------------------------------------- A10: posts from crawled HTML

EXTRACT_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()), T.StructField("time", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("replies", T.StringType()), T.StructField("retweets", T.StringType()),
    T.StructField("likes", T.StringType())])


#: Pages of a batch that are Python strings at a time.
PAGES_AT_ONCE = 64


def _extract_page(page_id, url, html):
    from postlens.sources.html_posts import extract_from_html
    return [(page_id, *row) for row in extract_from_html(url, html)]


def extract_posts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """A10: posts found in crawled pages, one row per post; promoted posts skipped; missing
    author → 'Unknown Author', missing time → 'DATEUNDEFINED'.  Posts in post markup carry their status
    id; an article's id is its page's host and path; duplicates of an id across pages keep the row of
    the lowest page id.  Each page is parsed inside its task by ``mapInArrow``, a few pages of a
    batch at a time."""
    import pyarrow as pa
    names = EXTRACT_SCHEMA.fieldNames()
    schema = pa.schema([(names[0], pa.int64()), *((n, pa.string()) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), PAGES_AT_ONCE):       # only some pages at a time become Python strings
                rows = []
                for pid, url, html in zip(*(c.to_pylist() for c in b.slice(at, PAGES_AT_ONCE).columns)):
                    if html is not None:
                        rows.extend(_extract_page(pid, url or "", html))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    raw = pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(run, EXTRACT_SCHEMA)
    raw = raw.where(F.col("id").isNotNull() & (F.col("id") != ""))
    posts = raw.select("page_id", "id", "author", "time", "content", F.struct(
        parse_km("replies").alias("replies"), parse_km("retweets").alias("retweets"),
        parse_km("likes").alias("likes")).alias("engagement"))
    return dedup_first(posts, "id", "page_id")
