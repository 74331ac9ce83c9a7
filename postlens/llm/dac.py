"""Operator 1: token-id output as directly addressable codes.

Each id is cut into byte chunks, lowest first.  Level 0 holds the first chunk of every id; a
continuation bitmap says which ids go on, and level ``l + 1`` holds the next chunk of those alone.
A rank directory (set bits before every 512-bit block) turns a position at one level into its
position at the next, so any token is read by one byte per level without decoding a block.

File layout (little-endian)::

    b"DAC1" | u32 levels | u64 tokens | u64 documents
    documents × i64 doc_id | documents × u8 null flag of the id | (documents + 1) × u64 first token
    per level: u64 n | n × u8 chunks | last level excepted: bitmap bytes | u64 directory

Files are written inside tasks through pyarrow's file systems, one or more per range partition.
A file gets a name of its own for each attempt, and only files named in the manifest — which Spark
commits atomically — count, so a lost executor or a repeated task leaves no doubt.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.llm.token_bytes import END_ID, encoder

MAGIC = b"DAC1"
BLOCK = 512
#: Tokens gathered in a task before a file is closed (bounds a task's memory).
FILE_TOKENS = 4_000_000


def _directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block of ``BLOCK`` bits, and their total at the end."""
    padded = np.zeros(-(-bits.size // BLOCK) * BLOCK, np.uint8)
    padded[:bits.size] = bits
    return np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1, dtype=np.uint64))]).astype("<u8")


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """``(chunks, continuation bits or None)`` of each level."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        more = rest > 0xFF
        last = not more.any()
        levels.append(((rest & 0xFF).astype(np.uint8), None if last else more))
        if last:
            return levels
        rest = rest[more] >> np.uint64(8)


def write_file(out, doc_ids: list, lengths: list[int], ids: np.ndarray) -> None:
    """Write documents (ids, lengths in tokens) and their concatenated token ids."""
    levels = encode_levels(ids)
    out.write(MAGIC + struct.pack("<IQQ", len(levels), ids.size, len(doc_ids)))
    out.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(np.concatenate([[0], np.cumsum(np.array(lengths, np.uint64))]).astype("<u8").tobytes())
    for chunks, bits in levels:
        out.write(struct.pack("<Q", chunks.size))
        out.write(chunks.tobytes())
        if bits is not None:
            out.write(np.packbits(bits, bitorder="little").tobytes())
            out.write(_directory(bits).tobytes())


class DacReader:
    """Random access to one file: ``get(i)`` reads one byte a level, ``slice(i, j)`` a run."""

    def __init__(self, source):
        self.source = source
        magic, levels, self.n_tokens, self.n_docs = struct.unpack("<4sIQQ", self._at(0, 24))
        if magic != MAGIC:
            raise ValueError("not a DAC1 file")
        at = 24
        ids = np.frombuffer(self._at(at, 8 * self.n_docs), "<i8")
        null = np.frombuffer(self._at(at + 8 * self.n_docs, self.n_docs), np.uint8)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        at += 9 * self.n_docs
        self.first = np.frombuffer(self._at(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []                                  # (chunks at, n, bitmap at, directory)
        for level in range(levels):
            n = struct.unpack("<Q", self._at(at, 8))[0]
            chunks, at = at + 8, at + 8 + n
            bitmap = directory = None
            if level < levels - 1:
                bitmap, size = at, 8 * (-(-n // BLOCK) + 1)
                directory = np.frombuffer(self._at(at + -(-n // 8), size), "<u8").astype(np.int64)
                at += -(-n // 8) + size
            self.levels.append((chunks, n, bitmap, directory))

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _bits(self, bitmap: int, i: int, j: int) -> np.ndarray:
        """Bits i (inclusive) to j (exclusive) of a bitmap."""
        raw = np.unpackbits(np.frombuffer(self._at(bitmap + i // 8, -(-j // 8) - i // 8), np.uint8), bitorder="little")
        return raw[i % 8: i % 8 + j - i].astype(bool)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i of a level."""
        _, _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        return int(directory[block]) + (int(self._bits(bitmap, block * BLOCK, i).sum()) if i % BLOCK else 0)

    def slice(self, i: int, j: int) -> np.ndarray:
        """Token ids i (inclusive) to j (exclusive)."""
        out, where, shift = np.zeros(max(0, j - i), np.uint32), np.arange(max(0, j - i)), 0
        for level, (chunks, _, bitmap, _) in enumerate(self.levels):
            if j <= i:
                break
            out[where] |= np.frombuffer(self._at(chunks + i, j - i), np.uint8).astype(np.uint32) << np.uint32(shift)
            if bitmap is None:
                break
            more = self._bits(bitmap, i, j)
            where, shift = where[more], shift + 8
            i, j = (r := self._rank(level, i)), r + int(more.sum())
        return out

    def get(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.first[k]), int(self.first[k + 1]))


def _writer(out_dir: str, vocab_path: str, end_id: int, file_tokens: int):
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("file", pa.string()),
                        ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, enc, end = TaskContext.get().partitionId(), encoder(vocab_path), np.uint32(end_id).tobytes()
        fs, base = common.file_system(out_dir)
        found, part = common.Collector(schema), 0
        docs, lengths, parts, total = [], [], [], 0

        def close():
            nonlocal docs, lengths, parts, total, part
            name = f"ids-{shard:06d}-{part:06d}-{uuid.uuid4().hex}.dac"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}") as out:
                write_file(out, docs, lengths, np.frombuffer(b"".join(parts), "<u4"))
            found.add(shard, part, name, len(docs), total)
            docs, lengths, parts, total, part = [], [], [], 0, part + 1

        for batch in batches:
            for doc_id, text in common.rows_of(batch, "doc_id", "text"):
                ids = enc.text(text) + end
                docs.append(doc_id)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                total += len(ids) // 4
                if total >= file_tokens:
                    close()
        if docs:
            close()
        yield from found.flush()
    return write, "shard long, part long, file string, n_docs long, n_tokens long"


def write_ids(docs: DataFrame, out_dir: str, vocab_path: str, end_id: int = END_ID,
              file_tokens: int = FILE_TOKENS, n_shards: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the ids in ascending doc_id order as DAC files below
    ``out_dir``; returns the committed manifest.

    Order: range partitions by doc_id, sorted by (doc_id, text) inside, null ids first, so repeated
    ids and rows have a fixed place.  A null text counts as empty (its end id alone).  An empty
    table gives no file.  Only doc_id and text are read; other columns may have any name."""
    spark = docs.sparkSession
    n = n_shards or common.partitions(spark)
    write, schema = _writer(f"{out_dir}/ids", vocab_path, end_id, file_tokens)
    manifest = (docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc())
                .sortWithinPartitions("doc_id", "text").mapInArrow(write, schema))
    manifest.write.parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def file_offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first_token``: ids in all files before.  One row per file of about four
    million tokens; sums per shard are ranked first, so no window spans more than the shard list."""
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = shards.select("shard", F.coalesce(
        F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (manifest.join(before, "shard")
            .withColumn("first_token", F.col("_b") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("_b"))


def read_ids(manifest: DataFrame, out_dir: str, with_ids: bool = False) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Collector(schema)
        for batch in batches:
            for name, first in common.rows_of(batch, "file", "first_token"):
                fs, path = common.file_system(f"{out_dir}/ids/{name}")
                with fs.open_input_file(path) as source:
                    reader = DacReader(source)
                    for k, doc_id in enumerate(reader.doc_ids):
                        ids = reader.document(k)
                        row = (doc_id, first + int(reader.first[k]), ids.size, zlib.crc32(ids.astype("<u4").tobytes()))
                        if out.add(*row, *([ids.tolist()] if with_ids else [])):
                            yield from out.flush()
        yield from out.flush()

    n = common.partitions(manifest.sparkSession)
    return file_offsets(manifest).select("file", "first_token").repartition(n, "file").mapInArrow(read, ddl)
