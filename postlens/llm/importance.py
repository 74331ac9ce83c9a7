"""Operator 12: importance resampling towards a target distribution, drawn by a parallel sort.

Texts become counts of hashed word runs.  One pass over all documents and one over the target texts sum
the counts per bucket; a bucket's gain is the rounded log ratio of its smoothed shares, and the gains are
one array of numbers.  The second pass over the documents turns each text into bucket numbers and adds up
the array at these places.  Hashes of word runs are composed from the words' own checksums, so a run is
never written out.

The draw is a sort by score (Gumbel noise added, so the highest scores are a sample without replacement).
Every partition sorts its own run; equally spaced elements of all runs are sorted once and give the
splitters; counts per segment tell which segments the draw reaches, only their rows are exchanged, each
segment is merged where it arrives, and a prefix sum of the counts turns places in a segment into ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.session import checkpoint_dir

BUCKETS = 10_000
MIN_WORDS, PER_CENT, SEED = 20, 5, 42
#: Sorted elements that give the splitters (16 bytes each, on the driver) and segments, at most.
SAMPLES, SEGMENTS = 500_000, 1_000
#: Distinct words kept per Python worker (it starts afresh beyond), and bytes of text counted at once.
CACHE_WORDS, PIECE_BYTES = 200_000, 1_000_000
#: Words of more bytes than this go through the checksum of the library instead of the tables.
TABLE_BYTES = 63

_WORD = bytes(c for c in range(256) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
#: A-Z to lower case, every other byte that is not part of a word to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def _shift_tables() -> np.ndarray:
    """``t[n, k, b]``: what byte k with value b of a checksum becomes after n more zero bytes; checksums
    are linear, so crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    t = np.zeros((TABLE_BYTES + 2, 4, 256), np.uint32)
    for n in range(len(t)):
        zeros = bytes(n)
        none = zlib.crc32(zeros)
        t[n] = [[zlib.crc32(zeros, b << (8 * k)) ^ none for b in range(256)] for k in range(4)]
    return t


class Words(dict):
    """word → its number; per number the checksum of the word, that of a space and the word, and the length
    of both."""

    def __init__(self):
        super().__init__()
        self.tables = _shift_tables()
        self.reset()

    def reset(self):
        self.clear()
        self.alone, self.spaced, self.size = [], [], []
        self.columns = [np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)]

    def arrays(self) -> list[np.ndarray]:
        """(alone, spaced, size); only words since the last call are converted."""
        for k, new in enumerate((self.alone, self.spaced, self.size)):
            done = self.columns[k]
            self.columns[k] = np.concatenate([done, np.array(new[len(done):], done.dtype)])
        return self.columns

    def __missing__(self, word: bytes) -> int:
        self.alone.append(zlib.crc32(word))
        self.spaced.append(zlib.crc32(b" " + word))
        self.size.append(len(word) + 1)
        self[word] = len(self.size) - 1
        return len(self.size) - 1

    def shift(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The checksums ``crc`` after ``size`` more zero bytes."""
        n = np.minimum(size, TABLE_BYTES + 1)
        t = self.tables
        out = t[n, 0, crc & 255] ^ t[n, 1, (crc >> 8) & 255] ^ t[n, 2, (crc >> 16) & 255] ^ t[n, 3, crc >> 24]
        for i in np.flatnonzero(size > TABLE_BYTES + 1).tolist():
            zeros = bytes(int(size[i]))
            out[i] = zlib.crc32(zeros, int(crc[i])) ^ zlib.crc32(zeros)
        return out


_WORDS: list[Words] = []


def words_cache() -> Words:
    if not _WORDS:
        _WORDS.append(Words())
    return _WORDS[0]


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[int], bool]]:
    """Texts in pieces of bounded size: (words, words of each text, does the first text go on from the
    last piece?).  A long text is cut at spaces."""
    words: list[bytes] = []
    sizes: list[int] = []
    held, on = 0, False
    for text in texts:
        rest = text.translate(_FOLD) if text else b""
        at = 0
        while True:
            stop = rest.find(b" ", at + PIECE_BYTES) if len(rest) - at > PIECE_BYTES else -1
            part = (rest[at:stop] if stop >= 0 else rest[at:] if at else rest).split()
            words += part
            sizes.append(len(part))
            held += (stop if stop >= 0 else len(rest)) - at
            if stop >= 0 or held >= PIECE_BYTES:
                yield words, sizes, on
                words, sizes, held, on = [], [], 0, stop >= 0
            if stop < 0:
                break
            at = stop
    if sizes:
        yield words, sizes, on


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """For each piece: (bucket of every run of 1 to 3 words, the text of each run, words of each text, does
    the first text go on?); texts are numbered within the piece."""
    known = words_cache()
    before: list[tuple[int, int, int]] = []                   # the last two words of a text that goes on
    for words, sizes, on in _pieces(texts):
        if len(known) > CACHE_WORDS:
            known.reset()
        number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        alone, spaced, size = (c[number] for c in known.arrays())
        text = np.repeat(np.arange(len(sizes)), sizes)
        old = len(before) if on else 0
        if old:
            a, s, n = (np.array(c, t) for c, t in zip(zip(*before), (np.uint32, np.uint32, np.int64)))
            alone, spaced, size = np.concatenate([a, alone]), np.concatenate([s, spaced]), np.concatenate([n, size])
            text = np.concatenate([np.zeros(old, np.int64), text])
        two = known.shift(alone[:-1], size[1:]) ^ spaced[1:] if len(alone) > 1 else alone[:0]
        three = known.shift(two[:-1], size[2:]) ^ spaced[2:] if len(alone) > 2 else alone[:0]
        fresh = np.arange(len(alone)) >= old                   # a run belongs to its last word
        in2 = (text[1:] == text[:-1]) & fresh[1:]
        in3 = (text[2:] == text[:-2]) & fresh[2:]
        runs = np.concatenate([alone[old:], two[in2], three[in3]])
        yield (runs % BUCKETS).astype(np.int64), np.concatenate([text[old:], text[1:][in2], text[2:][in3]]), np.array(sizes, np.int64), on
        last = text[-2:] == len(sizes) - 1 if len(text) else []
        before = [row for row, keep in zip(zip(alone[-2:].tolist(), spaced[-2:].tolist(), size[-2:].tolist()), last) if keep]


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for buckets, _, _, _ in features(_binary(batch, "text")):
            total += np.bincount(buckets, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; a partition sends at most one row per bucket."""
    total = np.zeros(BUCKETS, object)
    for r in texts.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1)(S + B)) / ((s + 1)(T + B)))) per bucket."""
    every, wanted = float(int(source.sum()) + BUCKETS), float(int(target.sum()) + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t + 1) * every) / (float(s + 1) * wanted))) for s, t in zip(source, target)], np.int64)


def _weigh(gains: np.ndarray):
    """Adds n_words, n_features and the sum of gains of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            at = 0
            for buckets, text, sizes, on in features(_binary(batch, "text")):
                at -= on
                here = slice(at, at + len(sizes))
                n_words[here] += sizes
                n_features[here] += np.bincount(text, minlength=len(sizes))
                order = np.argsort(text, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gains[buckets[order]])])
                ends = np.searchsorted(text[order], np.arange(len(sizes) + 1))
                weight[here] += np.diff(sums[ends])
                at += len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


# ------------------------------------------------------------------------------ sorting by regular sampling

_KEYS = ["k1", "k2", "k3"]


def _every(stride: int):
    """Every ``stride``-th element of a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = 0
        for batch in batches:
            at = np.arange(skip, batch.num_rows, stride)
            skip = (int(at[-1]) + stride if at.size else skip) - batch.num_rows
            if at.size:
                yield batch.take(pa.array(at))
    return run


def _segments(splitters: np.ndarray):
    """The number of splitters at or before each row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in _KEYS])
            lo, hi = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, len(splitters))
            while (lo < hi).any():                            # all rows halve their range at once
                mid = np.minimum((lo + hi) // 2, len(splitters) - 1)
                s = splitters[mid].T
                behind = (keys[0] > s[0]) | (keys[0] == s[0]) & ((keys[1] > s[1]) | (keys[1] == s[1]) & (keys[2] >= s[2]))
                open_ = lo < hi
                lo, hi = np.where(open_ & behind, mid + 1, lo), np.where(open_ & ~behind, mid, hi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo, pa.int32())], names=[*batch.schema.names, "segment"])
    return run


def _ranks(before: np.ndarray, draw: int):
    """Merged segments → the rank of each row: the rows of earlier segments and its place; null beyond
    the draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, place = -1, 0
        for batch in batches:
            of = batch.column(batch.schema.get_field_index("segment")).to_numpy()
            first = np.searchsorted(of, of)                   # sorted: where each row's segment begins
            places = np.arange(len(of)) - first + 1 + np.where(of == segment, place, 0)
            if len(of):
                segment, place = int(of[-1]), int(places[-1])
            rank = before[of] + places
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rank, pa.int64(), mask=rank > draw)], names=[*batch.schema.names[:-1], "rank"])
    return run


def rank_first(rows: DataFrame, share: int, samples: int = SAMPLES, segments: int = SEGMENTS) -> DataFrame:
    """``rows(k1, k2, k3, …)`` (whole-number keys, unique as a whole, null for rows that take no part) with
    ``rank``: 1, 2, 3… in the order of the keys for the first floor(share · N / 100) of the N rows that take
    part, null for all others."""
    runs = rows.sortWithinPartitions(*_KEYS).checkpoint()
    part = runs.where(F.col("k1").isNotNull())
    n = part.count()
    draw = share * n // 100
    none = F.lit(None).cast("long")
    if not draw:
        return runs.withColumn("rank", none)
    segments = max(1, min(segments, common.partitions(rows.sparkSession) * 100 // share))
    sample = part.select(*_KEYS).mapInArrow(_every(max(1, n // samples)), "k1 long, k2 long, k3 long").toArrow()
    found = np.stack([sample[k].to_numpy() for k in _KEYS], axis=1)
    found = found[np.lexsort(found.T[::-1])]
    splitters = found[np.arange(1, segments) * len(found) // segments]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    placed = part.mapInArrow(_segments(splitters), ddl + ", segment int").checkpoint()
    sizes = np.zeros(segments, np.int64)
    for r in placed.groupBy("segment").count().collect():       # at most SEGMENTS rows
        sizes[r["segment"]] = r["count"]
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    last = int(np.searchsorted(before, draw)) - 1               # the last segment that the draw reaches
    top = (placed.where(F.col("segment") <= last).repartitionById(last + 1, F.col("segment")).sortWithinPartitions("segment", *_KEYS)
           .mapInArrow(_ranks(before, draw), ddl + ", rank long"))
    rest = placed.where(F.col("segment") > last).select(*runs.columns, none.alias("rank"))
    return top.unionByName(rest).unionByName(runs.where(F.col("k1").isNull()).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, min_words: int = MIN_WORDS, per_cent: int = PER_CENT, seed: int = SEED,
             samples: int = SAMPLES, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: one row per row of ``docs(doc_id, text)``.

    Words are runs of digits, letters a-z (A-Z lowered) and all characters beyond ASCII; features are runs
    of 1 to 3 consecutive words.  A null or empty text has no words and the weight 0.  The score adds Gumbel
    noise from a hash of seed and doc_id (a null id counts as an empty one), so it depends on neither
    partitioning nor retries.  Of the N rows with at least ``min_words`` words the floor(per_cent · N / 100)
    highest scores are drawn and ranked, ties to the smaller doc_id (null last); repeated rows count, score
    and rank each for itself.  Empty tables give no rows; an empty ``target`` gives the uniform distribution;
    other columns are not read."""
    checkpoint_dir(docs.sparkSession)
    docs, target = docs.select("doc_id", "text"), target.select("text")
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    weighed = docs.mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + noise)
    # k3 tells repeated rows apart; it is fixed by the checkpoint
    takes = F.col("n_words") >= min_words
    scored = (scored.withColumn("k1", F.when(takes, -F.col("score"))).withColumn("k2", F.when(takes, F.coalesce("doc_id", F.lit((1 << 63) - 1))))
              .withColumn("k3", F.when(takes, F.monotonically_increasing_id())).checkpoint())
    return rank_first(scored, per_cent, samples, segments).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
