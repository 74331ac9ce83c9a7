"""A table with a unique key whose batches are committed, and published snapshots.

Rows lie in *segments*, one folder per committed batch, each cut into buckets by a hash of the key.  The
*ledger* holds one small file per commit, numbered without gaps; it names the writer, its batch and the
segment.  A file of the ledger appears by a rename that fails when the number is taken, so a commit is one
atomic step: before it nobody sees the segment, and of two writers that read the same version one gets the
number and the other starts over against the newer table.  A batch that the ledger knows is not written
again, whatever the stream's own checkpoint says.  Segments without a commit are left by broken writers and
never read.

A batch is compared with the stored keys of those buckets only that its own keys hash to.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.operators.sampling import dedup_first

BUCKETS = 64


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, folder: str) -> list[str]:
    at = _path(spark, folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _write(spark: SparkSession, path: str, text: str) -> None:
    at = _path(spark, path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str:
    at = _path(spark, path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _rename(spark: SparkSession, source: str, target: str, replace: bool) -> bool:
    """Moves a file; without ``replace`` False if the target is there already."""
    jvm = spark._jvm
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE" if replace else "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, source), _path(spark, target), options)
    except Exception as error:                                 # the JVM's exception class tells why
        if not replace and "FileAlreadyExists" in str(error):
            return False
        raise
    return True


@dataclass
class KeyedTable:
    """Insert-if-new table at ``path`` (created by the first commit)."""
    spark: SparkSession
    path: str
    key: str = "tweet_id"
    buckets: int = BUCKETS

    def commits(self) -> list[dict]:
        """The ledger, oldest first."""
        return [json.loads(_read(self.spark, f"{self.path}/ledger/{name}")) for name in _files(self.spark, f"{self.path}/ledger") if name.endswith(".json")]

    def read(self, commits: list[dict] | None = None) -> DataFrame | None:
        """All committed rows; None before the first commit."""
        commits = self.commits() if commits is None else commits
        return self._segments(commits).drop("_bucket") if commits else None

    def _segments(self, commits: list[dict]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{c['segment']}" for c in commits]).drop("_segment")

    def insert(self, batch: DataFrame, writer: str, batch_id: int, order_col: str | None = None, attempts: int = 20) -> dict:
        """Adds the rows whose key is not stored; of rows with one key in the batch the first.  Returns the
        commit (``pushed``, ``failed`` rows), the earlier one if the batch was committed before."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        first = dedup_first(batch, self.key, order_col or [c for c in batch.columns if c != self.key][0]).withColumn("_bucket", bucket).persist()
        try:
            total = batch.count()
            for _ in range(attempts):
                commits = self.commits()
                known = [c for c in commits if (c["writer"], c["batch"]) == (writer, batch_id)]
                if known:
                    return known[0]
                fresh = first
                if commits:
                    touched = [r["_bucket"] for r in first.select("_bucket").distinct().collect()]          # at most ``buckets``
                    stored = self._segments(commits).where(F.col("_bucket").isin(touched)).select(self.key, "_bucket")
                    fresh = first.join(stored, [self.key, "_bucket"], "left_anti")
                segment = f"_segment={uuid.uuid4().hex}"
                fresh.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{segment}")
                pushed = self.spark.read.schema(first.schema).parquet(f"{self.path}/data/{segment}").count()
                commit = {"writer": writer, "batch": batch_id, "segment": segment, "pushed": pushed, "failed": total - pushed}
                if self._commit(len(commits), commit):
                    return commit
            raise RuntimeError(f"{attempts} commits were taken by other writers")
        finally:
            first.unpersist()

    def _commit(self, version: int, commit: dict) -> bool:
        name = f"{self.path}/ledger/{version:012d}.json"
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        _write(self.spark, draft, json.dumps(commit))
        _write_folder(self.spark, f"{self.path}/ledger")
        return _rename(self.spark, draft, name, replace=False)


def _write_folder(spark: SparkSession, folder: str) -> None:
    at = _path(spark, folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def publish(spark: SparkSession, path: str, table: DataFrame) -> None:
    """Writes a new version of a table below ``path`` and turns the pointer to it: readers see the old version
    whole or the new one whole, a crash leaves the old one."""
    version = uuid.uuid4().hex
    table.write.parquet(f"{path}/versions/{version}")
    draft = f"{path}/draft-{version}"
    _write(spark, draft, version)
    _rename(spark, draft, f"{path}/CURRENT", replace=True)


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version; None before the first."""
    if "CURRENT" not in _files(spark, path):
        return None
    return spark.read.parquet(f"{path}/versions/{_read(spark, f'{path}/CURRENT')}")
