"""Committed inserts (A8, S1, S2) and published versions (S4): replays, crashes, two writers."""

import pytest

from postlens.sources import keyed_table as KT
from postlens.streaming import ingest as ST


@pytest.fixture
def table(spark):
    return KT.KeyedTable(spark, ST.scratch_path(spark, "keyed"), buckets=4)


def batch(spark, rows):
    return spark.createDataFrame(rows, "tweet_id string, time int, content string")


def stored(table):
    return sorted(tuple(r) for r in table.read().select("tweet_id", "time", "content").collect())


def test_inserts_new_keys_only(spark, table):
    assert table.read() is None
    one = table.insert(batch(spark, [("a", 2, "late"), ("a", 1, "first"), ("b", 1, "x")]), "w", 0, "time")
    two = table.insert(batch(spark, [("b", 0, "other"), ("c", 5, "y")]), "w", 1, "time")
    assert (one["pushed"], one["failed"], two["pushed"], two["failed"]) == (2, 1, 1, 1)
    assert stored(table) == [("a", 1, "first"), ("b", 1, "x"), ("c", 5, "y")]
    assert table.insert(batch(spark, []), "w", 2, "time")["pushed"] == 0 and len(stored(table)) == 3


def test_replayed_batch_is_the_same_commit(spark, table):
    rows = batch(spark, [("a", 1, "x")])
    assert table.insert(rows, "w", 7) == table.insert(batch(spark, [("z", 1, "changed")]), "w", 7)
    assert stored(table) == [("a", 1, "x")] and len(table.commits()) == 1
    table.insert(batch(spark, [("z", 1, "other writer")]), "v", 7)
    assert len(stored(table)) == 2


def test_crash_between_write_and_commit(spark, table, monkeypatch):
    table.insert(batch(spark, [("a", 1, "x")]), "w", 0)

    def broken(self, *_):
        raise OSError("gone")
    with monkeypatch.context() as m:
        m.setattr(KT.KeyedTable, "_commit", broken)
        with pytest.raises(OSError):
            table.insert(batch(spark, [("b", 1, "y")]), "w", 1)
    assert stored(table) == [("a", 1, "x")]                   # the segment is there, but nobody sees it
    assert table.insert(batch(spark, [("b", 1, "y")]), "w", 1)["pushed"] == 1
    assert stored(table) == [("a", 1, "x"), ("b", 1, "y")]


def test_two_writers_insert_a_key_once(spark, table, monkeypatch):
    """Another writer commits the same key between this one's read and its commit."""
    plain, met = KT.KeyedTable._commit, []

    def late(self, version, commit):
        if not met:
            met.append(1)
            other = KT.KeyedTable(spark, table.path, buckets=4)
            other.insert(batch(spark, [("a", 9, "theirs"), ("b", 9, "theirs")]), "other", 0)
        return plain(self, version, commit)
    monkeypatch.setattr(KT.KeyedTable, "_commit", late)
    mine = table.insert(batch(spark, [("a", 1, "mine"), ("c", 1, "mine")]), "me", 0)
    assert (mine["pushed"], mine["failed"]) == (1, 1)
    assert stored(table) == [("a", 9, "theirs"), ("b", 9, "theirs"), ("c", 1, "mine")]
    assert [c["writer"] for c in table.commits()] == ["other", "me"]


def test_only_touched_buckets_are_read(spark, table):
    table.insert(batch(spark, [(f"k{i}", i, "x") for i in range(200)]), "w", 0)
    from pyspark.sql import functions as F
    plan = table._segments(table.commits()).where(F.col("_bucket").isin([1])).select("tweet_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan or "_bucket" in plan.split("PartitionFilters")[1][:80]


def test_stream_restarts_without_its_checkpoint(spark, table):
    """All files are read again; the ledger and the keys keep every post single."""
    path = ST.scratch_path(spark, "raw")
    for k in range(3):
        batch(spark, [(f"p{i}", i, "x") for i in range(k * 5, k * 5 + 8)]).write.mode("append").json(path)
    for run in range(2):
        stream = spark.readStream.schema("tweet_id string, time int, content string").option("maxFilesPerTrigger", 2).json(path)
        ST.ingest_stream(spark, stream, table.path, ST.scratch_path(spark, "ckpt")).awaitTermination()
        assert [r[0] for r in stored(KT.KeyedTable(spark, table.path))] == sorted(f"p{i}" for i in range(18))


def test_published_versions(spark, monkeypatch):
    path = ST.scratch_path(spark, "weekly")
    assert KT.published(spark, path) is None
    KT.publish(spark, path, spark.range(3))
    old = KT.published(spark, path)
    monkeypatch.setattr(KT, "_rename", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        KT.publish(spark, path, spark.range(5))
    assert KT.published(spark, path).count() == 3 == old.count()
    monkeypatch.undo()
    KT.publish(spark, path, spark.range(7))
    assert KT.published(spark, path).count() == 7 and old.count() == 3
