"""Sources, search options, rule labels, crawl state and streaming twins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from postlens.operators import crawl as CR
from postlens.operators import rules as R
from postlens.operators import search as SE
from postlens.operators import timeseries as TS
from postlens.sources import ingest as IN
from postlens.sources.keyed_table import KeyedTable
from postlens.streaming import ingest as ST


def test_normalize_extended_json(spark, tmp_path):
    doc = [{"_id": {"$oid": "x"}, "tweet_id": "1", "time": {"$date": "2025-03-20T10:00:00.000Z"},
            "author": "a", "content": "c", "comment_count": 1, "repost_count": 2, "like_count": 3,
            "view_count": 4, "created_at": {"$date": "2025-03-21T00:00:00Z"}, "__v": 0}]
    p = tmp_path / "dump.json"
    p.write_text(json.dumps(doc))
    df = IN.normalize_posts(IN.read_json_array(spark, str(p), IN.RAW_DUMP_SCHEMA))
    r = df.first().asDict()
    assert "_id" not in r and "__v" not in r and "created_at" not in r
    assert r["time"] == "2025-03-20T10:00:00.000"


def test_labelled_dir(spark, tmp_path):
    for folder, name, text in [("pos", "a.txt", "good"), ("neg", "b.txt", "bad"), ("unsup", "c.txt", "x")]:
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = sorted((r["text"], r["label"]) for r in IN.read_labelled_dir(spark, str(tmp_path)).collect())
    assert got == [("bad", 0), ("good", 1)]


def test_validate_modes(spark):
    df = spark.createDataFrame([("t", "a", "c", "d"), (None, "a", "c", "d")],
                               "time STRING, author STRING, content STRING, data STRING")
    v, r = IN.validate_posts(df, mode="row")
    assert (v.count(), r.count()) == (1, 1)
    v, r = IN.validate_posts(df, mode="all")
    assert (v.count(), r.count()) == (0, 2)


def test_min_content_js_split(spark):
    df = spark.createDataFrame([("a b c",), ("a  b c",), ("a b c d",), ("",)], "content STRING")
    assert [r[0] for r in IN.min_content(df, min_words=4).collect()] == ["a  b c", "a b c d"]


def test_insert_new(spark):
    stored = spark.createDataFrame([("1",)], "tweet_id STRING")
    batch = spark.createDataFrame([("1", 1), ("2", 5), ("2", 3), ("3", 1)], "tweet_id STRING, t INT")
    fresh, report = IN.insert_new(stored, batch, order_col="t")
    assert sorted((r["tweet_id"], r["t"]) for r in fresh.collect()) == [("2", 3), ("3", 1)]
    assert report.first().asDict() == {"pushed": 2, "failed": 2}


def test_extract_posts_from_tweet_markup(spark):
    html = ('<div data-testid="tweet"><div data-testid="User-Name">Ani</div>'
            '<a href="/ani/status/99"><time datetime="2025-01-01T00:00:00.000Z">t</time></a>'
            '<div data-testid="tweetText">tolak ruu</div><div data-testid="like">1.5K</div></div>'
            '<div data-testid="tweet"><div data-testid="promotedTweet"></div>'
            '<a href="/ad/status/5"><time datetime="x">t</time></a></div>'
            '<div data-testid="tweet"><a href="/b/status/7"><time>t</time></a></div>')
    pages = spark.createDataFrame([(1, "https://x.com/s", html), (2, "https://x.com/s", html)],
                                  "page_id LONG, url STRING, html STRING")
    out = {r["id"]: r for r in IN.extract_posts(pages).collect()}
    assert set(out) == {"99", "7"}
    assert out["99"]["engagement"]["likes"] == 1500.0 and out["99"]["author"] == "Ani"
    assert out["7"]["author"] == "Unknown Author" and out["7"]["time"] == "DATEUNDEFINED"


def test_search_options_validation():
    with pytest.raises(ValueError):
        SE.SearchOptions(includes=["a"], exact="b").validate()
    with pytest.raises(ValueError):
        SE.SearchOptions().validate()
    with pytest.raises(ValueError):
        SE.SearchOptions(exact="a", filters=["bogus"]).validate()


def test_search_predicate(spark):
    df = spark.createDataFrame([("Tolak RUU TNI", "a", "2025-01-02"), ("tolakan ruu", "b", "2025-01-02"),
                                ("RUU tni lagi", "a", "2024-12-30")], "content STRING, author STRING, d STRING") \
        .withColumn("time", F.col("d").cast("timestamp_ntz"))
    got = SE.search_posts(df, SE.SearchOptions(includes=["tolak", "ruu"], since="2025-01-01")).collect()
    assert [r["content"] for r in got] == ["Tolak RUU TNI"]
    got = SE.search_posts(df, SE.SearchOptions(either=["lagi", "tolakan"], by="A")).collect()
    assert [r["content"] for r in got] == ["RUU tni lagi"]


def test_relevance_rules_golden(spark):
    texts = ["giveaway hp murah #tolakruutni", "tolak revisi uu tni sekarang", "ruu polri bahaya #ruutni",
             "dirgahayu tni kita", "setuju banget #indonesiagelap", "#tolakruutni #ruutni",
             "makan siang enak #saveourdemocracy", "cuaca cerah"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tweet_id INT, content STRING")
    got = [(r["rule"], r["label"]) for r in R.rule_label(df, R.RELEVANCE_RULES).orderBy("tweet_id").collect()]
    assert got == [("layer0_spam", False), ("layer1_core", True), ("layer2_package", True),
                   ("layer3_general", False), ("layer4a_opinion", True), ("layer4b_hashtag_only", True),
                   ("layer4c_mismatch", False), ("default", False)]


def test_sentiment_rules_golden(spark):
    texts = ["DPR sahkan RUU TNI", "polisi arogan", "tolak ruu tni dan polri", "dasar mulyono",
             "titip sandal", "biasa saja"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tweet_id INT, content STRING")
    got = [r["label"] for r in R.rule_label(df, R.SENTIMENT_RULES).orderBy("tweet_id").collect()]
    assert got == [1, 1, 0, 0, 1, 1]


def test_next_cursor_steps_back(spark):
    log = spark.createDataFrame([("r", "2025-01-02 00:00:00", "2025-01-02 10:00:00", "2025-01-02 12:00:00")],
                                "run_id STRING, started_at STRING, smallest_date STRING, timeline_start_date STRING")
    log = log.select("run_id", *[F.col(c).cast("timestamp_ntz").alias(c)
                                 for c in ("started_at", "smallest_date", "timeline_start_date")])
    r = CR.next_cursor(log, until="2025-01-05").first()
    assert str(r["next_timeline_start"]) == "2025-01-01 10:00:00" and r["done"]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(str(i), f"2024-01-{1 + i % 20:02d} 10:00:00", i % 3, f"post {i}") for i in range(40)]
    src = tmp_path / "in"
    df = spark.createDataFrame(rows, "tweet_id STRING, t STRING, sentiment INT, content STRING") \
        .withColumn("time", F.col("t").cast("timestamp_ntz")).drop("t")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    table = str(tmp_path / "posts")
    q = ST.ingest_stream(spark, stream, table, str(tmp_path / "ck"))
    q.awaitTermination()
    assert KeyedTable(spark, table).read().count() == 40
    q = ST.ingest_stream(spark, spark.readStream.schema(df.schema).parquet(str(src)), table, str(tmp_path / "ck2"))
    q.awaitTermination()                                   # replay: nothing new is inserted
    assert KeyedTable(spark, table).read().count() == 40
    weekly = ST.run_weekly_stream(spark, spark.readStream.schema(df.schema).parquet(str(src)))
    batch = TS.add_scores(TS.weekly_counts(df, spine=False))
    key = lambda r: (r["week_end"], r["count_neg"], r["count_neu"], r["count_pos"])
    assert sorted(map(key, weekly.collect())) == sorted(map(key, batch.collect()))


def test_month_partitions_prune(spark, tmp_path):
    df = spark.createDataFrame([("1", "2024-01-05 10:00:00"), ("2", "2024-02-05 10:00:00")], "tweet_id STRING, t STRING") \
        .withColumn("time", F.col("t").cast("timestamp_ntz")).drop("t")
    IN.write_posts_by_month(df, str(tmp_path / "posts"))
    back = spark.read.parquet(str(tmp_path / "posts")).where(F.col("month") == "2024-02")
    assert [r["tweet_id"] for r in back.collect()] == ["2"]
    assert "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().executedPlan().toString()


def test_append_new_only_takes_a_missing_table_as_empty(spark, tmp_path):
    import pytest
    from postlens.sources import ingest as IN
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "tweet_id string, v int")
    path = str(tmp_path / "posts")
    assert IN.append_new(spark, path, batch).collect()[0]["pushed"] == 2
    assert IN.append_new(spark, path, batch).collect()[0]["pushed"] == 0
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception):
        IN.append_new(spark, str(tmp_path / "broken"), batch)


def test_stream_keeps_posts_of_any_age(spark, tmp_path):
    """Duplicates, a replayed file and a post twenty years older than the newest."""
    from postlens.streaming import ingest as ST
    src, out = tmp_path / "in", str(tmp_path / "posts")
    rows = [[("1", "2024-05-01"), ("1", "2024-05-01")], [("2", "2004-01-01"), ("3", "2003-01-01")], [("1", "2024-05-01"), ("4", "1999-01-01")]]
    schema = "tweet_id string, time timestamp"
    for batch in rows:
        df = spark.createDataFrame(batch, "tweet_id string, t string").selectExpr("tweet_id", "cast(t as timestamp) time")
        df.coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        ST.ingest_stream(spark, stream, out, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r.tweet_id for r in KeyedTable(spark, out).read().collect()) == ["1", "2", "3", "4"]
