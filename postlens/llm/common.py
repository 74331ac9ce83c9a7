"""Helpers shared by the training-data operators: run folders in the shared store, remote-capable
file access inside tasks, Arrow batch iteration and partition counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import checkpoint_dir

#: Rows and text bytes gathered before an operator hands an Arrow batch back to Spark.
OUT_ROWS = 4096


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run under ``spark.checkpoint.dir`` (shared by driver and executors)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_SHIFT = str(1 << 63)


def vertex(first_id: str, rest: Column) -> Column:
    """Text that sorts by a whole number, then by ``rest``: a class named by its smallest id, so that the
    smallest vertex of a component names the component's smallest id."""
    shifted = F.col(first_id).cast("decimal(20,0)") + F.lit(_SHIFT).cast("decimal(20,0)")
    return F.concat(F.lpad(shifted.cast("string"), 20, "0"), rest)


def first_id(vertex: str) -> Column:
    """The whole number of ``vertex``."""
    return (F.substring(vertex, 1, 20).cast("decimal(20,0)") - F.lit(_SHIFT).cast("decimal(20,0)")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def file_system(uri: str):
    """``(pyarrow file system, path)`` of a URI or of a plain local path."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


class Collector:
    """Gathers rows column-wise and yields Arrow batches of a schema."""

    def __init__(self, schema: pa.Schema, limit: int = OUT_ROWS):
        self.schema, self.limit = schema, limit
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *row) -> bool:
        for c, v in zip(self.columns, row):
            c.append(v)
        return len(self.columns[0]) >= self.limit

    def extend(self, *columns) -> bool:
        for c, v in zip(self.columns, columns):
            c.extend(v)
        return len(self.columns[0]) >= self.limit

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
            self.columns = [[] for _ in self.schema]
