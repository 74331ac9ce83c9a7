"""Operator 6: order-preserving packing by dynamic programming.

Documents keep their doc_id order.  A sequence is a window between two cuts of at most ``size``
tokens.  Every sequence has a price, and so has its cut unless a document ends there: ``SENTENCE``
after a sentence, ``INNER`` elsewhere.  With ``f[j]`` the least cost of a packing that ends in a cut at
position ``p[j]``::

    f[j] = price(j) + min over i < j, p[j] - p[i] <= size of  f[i] + padding(p[j] - p[i])

A window is padded to ``size`` unless its length is a power of two.  Padding is linear in ``p[i]``,
so the best ``i`` is the least ``f[i] + p[i]`` in a sliding window: a monotone queue gives it in
constant time; the powers of two are looked up one by one.  Candidate cuts are all document and
sentence ends, one position every ``stride`` tokens where neither comes, and — so that windows can be
filled to the last token or end at a power of two — the points ``size`` after the start of each document,
the multiples of ``size``, and powers of two before the end of the run.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.llm.token_bytes import END_ID, encoder

SIZE = 4096
#: Prices in padding tokens: of every sequence (so that short ones are made only where they save
#: more), and of a cut after a document, after a sentence and elsewhere.
SEQUENCE, DOCUMENT, SENTENCE, INNER = 16, 0, 1, 12
PRICES = (SEQUENCE + DOCUMENT, SEQUENCE + SENTENCE, SEQUENCE + INNER)
STRIDE = 64
#: Tokens packed by one run of the dynamic program (bounds memory; the tail of a run is closed).
RUN_TOKENS = 2_000_000

DOC, SENT, MID = 0, 1, 2


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions (0 and the end included) and their kinds."""
    total = int(doc_ends[-1])
    natural = np.unique(np.concatenate([[0], doc_ends, sentence_ends])).astype(np.int64)
    # between natural cuts that lie far apart, one every ``stride`` tokens
    gaps = np.maximum((np.diff(natural) - 1) // stride, 0)
    nth = np.arange(gaps.sum()) - np.repeat(np.cumsum(gaps) - gaps, gaps) + 1
    inner = np.repeat(natural[:-1], gaps) + nth * stride
    # full windows counted from the start; powers of two from the end, and the parts of what remains
    powers = 1 << np.arange(size.bit_length())
    rest = powers[::-1][(total % size) & powers[::-1] > 0]
    tail = total - total % size + np.concatenate([[0], np.cumsum(rest)])
    filled = np.concatenate([[0], doc_ends]) + size            # a window that begins where a document does
    middle = np.concatenate([inner, filled, np.arange(size, total, size), total - powers, tail])
    positions = np.concatenate([[0], doc_ends, sentence_ends, middle[(middle > 0) & (middle < total)]]).astype(np.int64)
    kinds = np.repeat([DOC, SENT, MID], [1 + len(doc_ends), len(sentence_ends), len(positions) - 1 - len(doc_ends) - len(sentence_ends)])
    order = np.lexsort((kinds, positions))
    positions, kinds = positions[order], kinds[order]
    first = np.concatenate([[True], positions[1:] != positions[:-1]])
    return positions[first], kinds[first]


def best_cuts(positions: np.ndarray, kinds: np.ndarray, size: int, prices=PRICES) -> list[int]:
    """Positions of the cheapest packing's cuts, first and last included."""
    # windows whose length is a power of two: pairs (j, i), in the order of j
    ends, starts = [], []
    for k in range(size.bit_length()):
        at = np.searchsorted(positions, positions - (1 << k))
        hit = np.flatnonzero(positions[at] == positions - (1 << k))
        ends.append(hit)
        starts.append(at[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    starts = starts[order].tolist()
    upto = np.searchsorted(ends[order], np.arange(len(positions)), side="right").tolist()
    p, price = positions.tolist(), np.array(prices)[kinds].tolist()
    f, back, key = [0] * len(p), [0] * len(p), [0] * len(p)    # key: f[i] + p[i]
    queue: deque[int] = deque([0])
    seen = upto[0]
    for j in range(1, len(p)):
        x = p[j]
        while p[queue[0]] < x - size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - x
        while seen < upto[j]:
            k = starts[seen]
            seen += 1
            if f[k] < best:
                best, i = f[k], k
        best += price[j]
        f[j], back[j] = best, i
        best = key[j] = best + x
        while queue and key[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts, j = [p[-1]], len(p) - 1
    while j:
        j = back[j]
        cuts.append(p[j])
    return cuts[::-1]


def pack_run(lengths: list[int], ids: np.ndarray, ends: np.ndarray, size: int, stride: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one run of documents."""
    doc_ends = np.cumsum(np.array(lengths, np.int64))
    sentence_ends = np.flatnonzero(ends[np.minimum(ids, ends.size - 1)]) + 1
    cuts = best_cuts(*candidates(doc_ends, sentence_ends, size, stride), size)
    # a piece ends at every cut and at every document end
    bounds = np.union1d(np.array(cuts, np.int64), doc_ends)
    starts, stops = np.concatenate([[0], bounds[bounds > 0][:-1]]), bounds[bounds > 0]
    doc = np.searchsorted(doc_ends, starts, side="right")
    seq = np.searchsorted(np.array(cuts[1:], np.int64), starts, side="right")
    doc_first = np.concatenate([[0], doc_ends[:-1]])
    return list(zip(doc.tolist(), (starts - doc_first[doc]).tolist(), (stops - starts).tolist(),
                    seq.tolist(), (starts - np.array(cuts, np.int64)[seq]).tolist()))


def pack(docs: DataFrame, vocab_path: str, size: int = SIZE, end_id: int = END_ID, stride: int = STRIDE,
         run_tokens: int = RUN_TOKENS, with_ids: bool = False, n_shards: int | None = None) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``size`` tokens.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    (and ``ids``).  Range partitions by doc_id are packed on their own; a partition is worked off in
    runs of about ``run_tokens`` tokens, so memory is bounded and no document is held back.  The
    sequence id is the partition's number times 2^32 plus the count inside it.

    Null texts are empty documents of the end id alone; null and repeated ids are packed as rows of
    their own in (doc_id, text) order; an empty table gives no rows; other columns are not read.  A
    single document longer than a run is one run."""
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    ddl = ", ".join(f"{n} long" for n, _ in fields) + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        enc, end = encoder(vocab_path), np.uint32(end_id).tobytes()
        ends = enc.sentence_ends()
        out = common.Collector(schema)
        names, lengths, parts, total, done = [], [], [], 0, 0

        def close():
            nonlocal names, lengths, parts, total, done
            ids = np.frombuffer(b"".join(parts), "<u4")
            doc_first = np.concatenate([[0], np.cumsum(lengths)])
            most = -1
            for d, start, length, seq, offset in pack_run(lengths, ids, ends, size, stride):
                piece = ids[doc_first[d] + start: doc_first[d] + start + length]
                most = max(most, seq)
                yield (names[d], start, length, zlib.crc32(piece.tobytes()), lengths[d], first + done + seq, offset,
                       *([piece.tolist()] if with_ids else []))
            names, lengths, parts, total, done = [], [], [], 0, done + most + 1

        for batch in batches:
            for doc_id, text in common.rows_of(batch, "doc_id", "text"):
                ids = enc.text(text) + end
                names.append(doc_id)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                total += len(ids) // 4
                if total >= run_tokens:
                    for row in close():
                        if out.add(*row):
                            yield from out.flush()
        if names:
            for row in close():
                if out.add(*row):
                    yield from out.flush()
        yield from out.flush()

    n = n_shards or common.partitions(docs.sparkSession)
    return (docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc())
            .sortWithinPartitions("doc_id", "text").mapInArrow(run, ddl))
