"""One text file per row, written by tasks into folders that a commit shows, read many to a task."""

import bz2
import glob
import gzip
import os

import pyarrow as pa
from pyspark.sql import functions as F

from postlens.sources import ingest as IN
from postlens.sources import text_files as TF


def batch(rows):
    return pa.RecordBatch.from_pydict({"folder": [f for f, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})


def test_a_file_per_row_and_nothing_beside(spark, tmp_path):
    rows = [("pos", "good"), ("neg", "bad\r\nline\n"), ("pos", None), ("neg", ""), ("pos", "good"), ("neg", "é \x00x")]
    df = spark.createDataFrame(rows, "folder STRING, text STRING").repartition(3)
    root = f"file://{tmp_path}/corpus"
    IN.write_labelled_dir(df, root)
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "corpus") for f in names]
    assert len(files) == len(rows) and all(f.endswith(".txt") for f in files)       # no checksum files
    got = sorted((r["text"], r["label"]) for r in IN.read_labelled_dir(spark, root).collect())
    assert got == sorted(((t or "") + "\n", int(f == "pos")) for f, t in rows)
    IN.write_labelled_dir(df.limit(0), root)                                        # adds nothing, loses nothing
    assert IN.read_labelled_dir(spark, root).count() == len(rows)


def test_no_rows(spark, tmp_path):
    IN.write_labelled_dir(spark.createDataFrame([], "folder STRING, text STRING"), str(tmp_path / "none"))
    assert IN.read_labelled_dir(spark, str(tmp_path / "none")).count() == 0


def test_only_committed_attempts_are_read(spark, tmp_path):
    def write(*batches):
        return [name for out in TF.file_writer(str(tmp_path))(iter(batches)) for name in out.column("attempt").to_pylist()]

    n = TF.FILES + 3
    rows = [("pos" if i % 3 else "neg", f"{i}") for i in range(n)]
    lost = write(batch(rows))                                                       # a task that failed after its files
    assert len(lost) == 2 and IN.read_labelled_dir(spark, str(tmp_path)).count() == 0
    TF.commit(str(tmp_path), write(batch(rows[:2000]), batch(rows[2000:])) + write())
    got = IN.read_labelled_dir(spark, str(tmp_path)).select(F.rtrim(F.regexp_replace("text", "\n", "")), "label").collect()
    assert sorted(map(tuple, got)) == sorted((t, int(f == "pos")) for f, t in rows)
    assert all(len(os.listdir(d)) <= TF.FILES for d in glob.glob(f"{tmp_path}/*/*"))


def test_many_files_share_a_task(spark, tmp_path):
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    os.makedirs(tmp_path / "pos")
    n = 32 * tasks + 32                                                             # one more scan partition
    for i in range(n):
        (tmp_path / "pos" / f"{i}.txt").write_text(f"{i}")
    df = IN.read_labelled_dir(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= tasks
    assert df.agg(F.count_distinct("text"), F.sum("label")).first() == (n, n)


def test_packed_files_are_unpacked(spark, tmp_path):
    os.makedirs(tmp_path / "neg")
    for name, data in [("a.txt.gz", gzip.compress(b"a")), ("B.GZ", gzip.compress(b"b")), ("c.bz2", bz2.compress(b"c")),
                       ("gz", b"d"), ("e.gz.txt", b"e"), ("f.txt", b"\xff")]:
        (tmp_path / "neg" / name).write_bytes(data)
    got = IN.read_labelled_dir(spark, str(tmp_path)).select(F.hex("text")).collect()
    assert sorted(r[0] for r in got) == ["61", "62", "63", "64", "65", "FF"]


def test_other_file_systems_take_the_text_sink(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.labelled.link./out", f"file://{tmp_path}")
    rows = [("pos", "good"), ("neg", "bad"), ("neg", None)]
    df = spark.createDataFrame(rows, "folder STRING, text STRING").repartition(2)
    IN.write_labelled_dir(df, "viewfs://labelled/out/corpus")
    got = sorted((r["text"], r["label"]) for r in IN.read_labelled_dir(spark, "viewfs://labelled/out/corpus").collect())
    assert got == [("\n", 0), ("bad\n", 0), ("good\n", 1)]
