"""Operator 7: chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed.  Inside texts a backslash is put before every
backslash, ``### `` and ``</turn>`` (inside roles also before ``:``), so control strings in a text
never end or start a turn and the escape is undone by dropping it.

Rows are range-partitioned and sorted by (conv_id, turn), so even a conversation with a third of all
rows is spread over tasks.  A task takes its rows in slices of about ``SLICE_BYTES``: segment lengths,
their running sum and the scatter index of every byte are numpy arrays, and headers and contents are
copied into one preallocated Arrow buffer, which becomes the output column as it is.

Output: one row per part of a conversation — the whole conversation unless it crosses the end of a
partition or is longer than a slice — with the formatted text and the loss mask as byte spans (each
assistant text).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import common

OPEN, AFTER_ROLE, CLOSE = b"### ", b": ", b"</turn>\n"
CONTROLS = (b"### ", b"</turn>")
ESCAPE = 0x5C
SLICE_BYTES = 2_000_000

PARTS = pa.schema([("conv_id", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()),
                   ("n_turns", pa.int64()), ("formatted", pa.string()),
                   ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
PARTS_DDL = ("conv_id long, shard long, part long, whole boolean, n_turns long, formatted string, "
             "loss_starts array<long>, loss_ends array<long>")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls are empty."""
    column = pa.concat_arrays([pc.fill_null(column.cast(pa.string()), "")])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _marked(data: np.ndarray, offsets: np.ndarray, single: bytes) -> np.ndarray:
    """Which bytes get an escape before them: those in ``single`` and the starts of control strings."""
    marks = np.isin(data, np.frombuffer(single, np.uint8))
    for control in CONTROLS:
        spots = np.flatnonzero(data[:max(0, data.size - len(control) + 1)] == control[0])
        for k, b in enumerate(control[1:], 1):
            spots = spots[data[spots + k] == b]
        row_end = offsets[np.searchsorted(offsets, spots, "right")]
        marks[spots[spots + len(control) <= row_end]] = True
    return marks


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted turns laid end to end: (buffer, turn offsets, starts and ends of the escaped texts)."""
    contents = []
    for column, single in ((role, b"\\:"), (text, b"\\")):
        data, offsets = _bytes(column)
        marks = _marked(data, offsets, single)
        before = np.concatenate([[0], np.cumsum(marks)])          # escapes before each byte
        contents.append((data, offsets, marks, before, np.diff(offsets) + np.diff(before[offsets])))
    n = len(role)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(OPEN), len(AFTER_ROLE), len(CLOSE)
    lengths[:, 1], lengths[:, 3] = contents[0][4], contents[1][4]
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    total = int(ends[-1, 4]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8) if total else np.zeros(0, np.uint8)
    out = out if out.flags.writeable else np.ndarray((total,), np.uint8, buffer)
    for k, header in ((0, OPEN), (2, AFTER_ROLE), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(header))] = np.frombuffer(header, np.uint8)
    for k, (data, offsets, marks, before, _) in zip((1, 3), contents):
        first = starts[:, k] - offsets[:-1] - before[offsets[:-1]]
        where = np.repeat(first, np.diff(offsets)) + np.arange(data.size) + before[1:]
        out[where] = data
        out[where[marks] - 1] = ESCAPE
    return buffer, np.concatenate([[0], ends[:, 4]]).astype(np.int64), starts[:, 3], ends[:, 3]


def _parts(rows: pa.Table, shard: int, first_part: int, edges: tuple[bool, bool]) -> pa.RecordBatch:
    """Format consecutive turns; a row per conversation.  edges: may the first, the last conversation
    have turns elsewhere?"""
    rows = rows.combine_chunks()
    ids, role, text = (rows.column(c).chunk(0) for c in ("conv_id", "role", "text"))
    buffer, turn_at, text_start, text_end = assemble(role, text)
    null, values = ids.is_null().to_numpy(False), pc.fill_null(ids, 0).to_numpy()
    change = np.flatnonzero((values[1:] != values[:-1]) | (null[1:] != null[:-1])) + 1
    lo, hi = np.concatenate([[0], change]), np.concatenate([change, [len(ids)]])
    loss = pc.fill_null(pc.equal(role, "assistant"), False).to_numpy(False)
    base = np.repeat(turn_at[lo], hi - lo)
    counts = np.concatenate([[0], np.cumsum(np.add.reduceat(loss, lo))]).astype(np.int32)
    whole = np.ones(len(lo), bool)
    whole[0], whole[-1] = whole[0] and not edges[0], whole[-1] and not edges[1]
    if len(lo) == 1:
        whole[0] = not (edges[0] or edges[1])
    offsets = pa.py_buffer(np.concatenate([turn_at[lo], turn_at[-1:]]).astype(np.int32).tobytes())
    spans = [pa.ListArray.from_arrays(pa.array(counts), pa.array((x - base)[loss], pa.int64())) for x in (text_start, text_end)]
    return pa.RecordBatch.from_arrays([
        ids.take(pa.array(lo)), pa.array(np.full(len(lo), shard)), pa.array(np.arange(len(lo)) + first_part), pa.array(whole),
        pa.array(hi - lo), pa.StringArray.from_buffers(len(lo), offsets, buffer), *spans], schema=PARTS)


def _format(slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, part = TaskContext.get().partitionId(), 0
        rest: pa.Table | None = None
        edge = True                      # may the first conversation of the rest have turns before it?

        def emit(rows: pa.Table, last_edge: bool):
            nonlocal part
            done = _parts(rows, shard, part, (edge, last_edge))
            part += done.num_rows
            return done

        for batch in batches:
            table = pa.Table.from_batches([batch]).select(["conv_id", "role", "text"])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while True:
                size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(rest.column("text")), 0)) + 40)
                if not size.size or size[-1] < slice_bytes:
                    break
                n = int(np.searchsorted(size, slice_bytes)) + 1
                ids = rest.column("conv_id").to_pylist()[:n + 1]
                cut = next((k for k in range(min(n, len(ids) - 1), 0, -1) if ids[k] != ids[k - 1]), None)
                yield emit(rest.slice(0, cut or n), cut is None)
                edge, rest = cut is None, rest.slice(cut or n)
        if rest is not None and rest.num_rows:
            yield emit(rest, True)
    return run


def format_chats(rows: DataFrame, slice_bytes: int = SLICE_BYTES, n_shards: int | None = None) -> DataFrame:
    """Format ``rows(conv_id, turn, role, text)``: one row per part of a conversation, in the order
    (conv_id, shard, part), with ``whole`` where the part is the whole conversation.

    Turns go in the order (turn, role, text), nulls first; null roles and texts are empty; rows
    without conv_id form one conversation of their own; repeated rows are repeated turns; an empty
    table gives no rows; other columns are not read."""
    n = n_shards or common.partitions(rows.sparkSession)
    return (rows.select("conv_id", "turn", "role", "text").repartitionByRange(n, F.col("conv_id").asc(), F.col("turn").asc())
            .sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(slice_bytes), PARTS_DDL))


def write_chats(rows: DataFrame, path: str, **options) -> None:
    format_chats(rows, **options).write.parquet(path)


_TURN = re.compile(rb"### ((?:[^\\:]+|\\.)*+): ((?:[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", data) if b"\\" in data else data


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of every turn of a formatted text; raises if anything else is in it."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        data = formatted.encode()
        for role, text in parse(data):
            self.turns.update(role + b"\n" + text + b"\n")
            self.n_turns += 1
        for a, b in zip(starts, ends):
            text = unescape(data[a:b])
            self.loss.update(text)
            self.loss_chars += len(text.decode())
        self.chars += len(formatted)

    def row(self, conv_id):
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order → one row per conversation; memory holds one part."""
    out = common.Collector(pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
    current, digest = None, None
    for batch in batches:
        for conv_id, whole, formatted, starts, ends in common.rows_of(batch, "conv_id", "whole", "formatted", "loss_starts", "loss_ends"):
            if digest is None or whole or conv_id != current:
                if digest is not None and out.add(*digest.row(current)):
                    yield from out.flush()
                current, digest = conv_id, _Digest()
            digest.add(formatted, starts, ends)
    if digest is not None:
        out.add(*digest.row(current))
    yield from out.flush()


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Read formatted parts back and digest them per conversation.  Whole conversations are done where
    they lie; the few that cross partitions are brought together by conv_id and streamed in order."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    parts = spark.read.parquet(path)
    whole = parts.where("whole").mapInArrow(_digest, ddl)
    split = (parts.where("not whole").repartition(common.partitions(spark), "conv_id")
             .sortWithinPartitions("conv_id", "shard", "part").mapInArrow(_digest, ddl))
    return whole.unionByName(split)
