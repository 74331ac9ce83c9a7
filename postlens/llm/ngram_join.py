"""Operator 10: n-gram Jaccard join by a MinHash LSH forest.

A document is an id and a text, as its set of shingles (runs of ``n`` words).  Documents with the same
words form a class; classes are numbered (``rep``) and compared by one text, that of the smallest id.

Forest: ``trees`` independent sequences of ``depth`` minima.  In a trie over the sequences of one
tree, two classes meet under a prefix; a prefix is the sorted key of that trie.  Classes that share
the longest prefix are candidates first.  Prefixes start at the longest length at which a pair exactly
at the threshold still meets in some tree with probability ``floor``, and are shortened as long as the
estimated recall — from how often the pairs that met under a prefix did so over all trees — is below
``target``.

Verification is exact: a link is found by comparing whole sets, and every pair that shares a prefix in
some tree is compared (pairs without one are not).  Candidates are never spelled out as pairs: every
class is tied to the smallest class under its prefix, connected components of these ties bring together
all that may match, and a component's shingle sets meet in one task, or — beyond ``TILE_SHINGLES`` or
``TILE_ROWS`` — in tasks for pairs of its tiles.  Each task enumerates the pairs that share a prefix,
compares their sets, and hands back one row per class: its links and its local component.  So a group
of thousands of near copies costs its comparisons, but no rows beyond its size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.operators.components import connected_components
from postlens.operators.joins import join_classes
from postlens.session import checkpoint_dir

N, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 7
FLOOR, TARGET = 0.995, 0.9995
#: A tile of a large component: at most so many shingles and classes.
TILE_SHINGLES, TILE_ROWS = 500_000, 500
CACHE_CHUNKS = 300_000

_WORD = re.compile(r"\w+")
_MASK = (1 << 32) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


class ChunkHashes(dict):
    """White-space chunk → the hashes of its words (runs of word characters, lower case) as bytes."""

    def __missing__(self, chunk: str) -> bytes:
        from xxhash import xxh64_intdigest
        found = np.array([xxh64_intdigest(w) for w in _WORD.findall(chunk.lower())], np.uint64).tobytes()
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def words(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""


_CHUNKS = ChunkHashes()


def shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words; a shorter text is one run; no words, no run."""
    if not words.size:
        return np.zeros(0, np.uint64)
    count = max(1, words.size - n + 1)
    h = np.full(count, np.uint64(min(n, words.size)))
    for k in range(min(n, words.size)):
        h = (h ^ (h >> np.uint64(29))) * _STEP + words[k:k + count]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def minima(sets: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """trees × depth minima of multiply-add hashes, as signed 32-bit numbers."""
    rng = np.random.default_rng(20_011)
    a = (rng.integers(0, 1 << 31, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]
    b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint64).astype(np.uint32)[:, None]
    x, least = (sets >> np.uint64(32)).astype(np.uint32), None
    for k in range(0, x.size, 4096):                          # bounded memory for very long texts
        some = (x[None, k:k + 4096] * a + b).min(1)
        least = some if least is None else np.minimum(least, some)
    return least.view(np.int32)


def meet_probability(similarity, length: int, trees: int):
    """Probability that two sets share a prefix of ``length`` in at least one of the trees."""
    return 1 - (1 - similarity ** length) ** trees


def _text_key():
    """Tells the texts of one id apart; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _signatures(n: int, trees: int, depth: int, *more: str):
    """``more``: binary columns to pass on."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.list_(pa.int32())),
                        *((name, pa.binary()) for name in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Collector(schema, 1024)
        for batch in batches:
            for doc_id, text, *rest in common.rows_of(batch, "doc_id", "text", *more):
                words = _CHUNKS.words(text)
                own = shingles(np.frombuffer(words, np.uint64), n)
                digest = hashlib.blake2b(words, digest_size=16).digest() if own.size and doc_id is not None else None
                if out.add(doc_id, digest, own.size, minima(own, trees, depth) if digest else None, *rest):
                    yield from out.flush()
        yield from out.flush()
    return run


def _verify(threshold: Fraction, trees: int):
    """Rows of one group at a time → links and local component (its smallest vertex) of each class."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("vertex", pa.string()), ("root", pa.string())])
    up, down = threshold.numerator, threshold.denominator

    def group(rows: list[tuple]) -> Iterator[tuple[int, int, str, str]]:
        vertices = [r[5] for r in rows]
        by_vertex = sorted(range(len(rows)), key=vertices.__getitem__)
        place = np.empty(len(rows), np.int64)
        place[by_vertex] = np.arange(len(rows))
        copies = np.array([r[1] for r in rows], np.int64)
        side = np.array([r[2] for r in rows])
        keys = np.array([r[3] for r in rows], np.int64)
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        n, sizes = len(rows), np.array([s.size for s in sets], np.int64)
        between = side.min() != side.max()                    # two tiles: only pairs across them
        may = np.zeros((n, n), bool)
        for t in range(trees):
            order = np.argsort(keys[:, t], kind="stable")
            k = keys[order, t]
            ends = np.flatnonzero(np.concatenate([k[1:] != k[:-1], [True]])) + 1
            for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
                if hi - lo > 1:
                    some = order[lo:hi]
                    may[some[:, None], some[None, :]] = True
        if between:
            may &= side[:, None] != side[None, :]
        may &= np.arange(n)[:, None] < np.arange(n)[None, :]
        # lengths alone rule a pair out
        small, large = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
        may &= down * small >= up * large
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        links, parent = np.zeros(n, np.int64), list(range(n))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x
        mark = np.zeros(names.size, np.int32)
        for i in np.flatnonzero(may.any(1)).tolist():
            others = np.flatnonzero(may[i])
            own = flat[starts[i]:starts[i + 1]]
            mark[own] = 1
            if others.size * 4 > n - i:                       # one sweep over all that follow
                common_size = np.add.reduceat(mark[flat[starts[i + 1]:]], starts[i + 1:n] - starts[i + 1])[others - i - 1]
            else:
                picked = np.concatenate([flat[starts[j]:starts[j + 1]] for j in others.tolist()])
                common_size = np.add.reduceat(mark[picked], np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
            mark[own] = 0
            found = others[down * common_size >= up * (sizes[i] + sizes[others] - common_size)]
            links[i] += copies[found].sum()
            links[found] += copies[i]
            for j in found.tolist():
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        roots = np.array([find(i) for i in range(n)])
        least = place.copy()
        np.minimum.at(least, roots, place)
        for i in np.flatnonzero(links > 0).tolist():
            yield rows[i][0], int(links[i]), vertices[i], vertices[by_vertex[least[roots[i]]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, rows = common.Collector(schema), None, []
        for batch in batches:
            for comp, x, y, *row in common.rows_of(batch, "comp", "x", "y", "rep", "copies", "side", "keys", "shingles", "vertex"):
                if (comp, x, y) != current:
                    if len(rows) > 1:
                        for found in group(rows):
                            if out.add(*found):
                                yield from out.flush()
                    current, rows = (comp, x, y), []
                if not rows or rows[-1][0] != row[0]:         # a row of docs may occur several times
                    rows.append(row)
        if len(rows) > 1:
            for found in group(rows):
                out.add(*found)
        yield from out.flush()
    return run


def _prefixes(classes: DataFrame, length: int, trees: int, depth: int) -> DataFrame:
    return classes.withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(
        t, F.slice("sig", t * depth + 1, length))))


def _ties(classes: DataFrame, length: int, trees: int, depth: int) -> DataFrame:
    """``rep, least, met``: each class, the smallest class under one of its prefixes, in how many trees."""
    rows = _prefixes(classes, length, trees, depth).select("rep", F.posexplode("keys").alias("tree", "key"))
    shared = rows.groupBy("tree", "key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    return (rows.join(shared.select("tree", "key", "least"), ["tree", "key"]).where("rep != least")
            .groupBy("rep", "least").agg(F.count(F.lit(1)).alias("met")).checkpoint())


def estimated_recall(ties: DataFrame, length: int, trees: int, threshold: float) -> float:
    """Of the pairs as similar as those that met (and at least the threshold), the part that meets."""
    similarity = F.pow(F.col("met") / trees, 1.0 / length)
    s = F.greatest(similarity, F.lit(threshold))
    missed = F.pow(1 - F.pow(s, length), trees)
    row = ties.where(similarity >= threshold - 0.1).agg(F.sum(1 / (1 - missed)).alias("all"), F.count(F.lit(1)).alias("n")).first()
    return row["n"] / row["all"] if row["n"] else 1.0


def candidate_ties(classes: DataFrame, threshold: float, trees: int, depth: int, floor: float, target: float) -> tuple[DataFrame, int]:
    """Ties under the longest prefixes that reach the recall, and the prefixes' length."""
    length = next((k for k in range(depth, 1, -1) if meet_probability(threshold, k, trees) >= floor), 1)
    while True:
        ties = _ties(classes, length, trees, depth)
        if length == 1 or estimated_recall(ties, length, trees, threshold) >= target:
            return ties, length
        length -= 1


def _decisions(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
               floor: float = FLOOR, target: float = TARGET) -> DataFrame:
    """The rows of ``near_duplicates``, each with the key of one of its texts (``text_key``)."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    parts = common.partitions(spark)
    docs = docs.select("doc_id", "text", _text_key().alias("text_key"))
    signed = docs.mapInArrow(_signatures(n, trees, depth, "text_key"),
                             "doc_id long, digest binary, n_shingles long, sig array<int>, text_key binary").checkpoint()
    members = signed.select("doc_id", "digest", "text_key")
    named = members.where("digest is not null").groupBy("doc_id", "digest").agg(F.min("text_key").alias("text_key"))
    copies = (named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("copies"))
              .select("digest", "first.doc_id", "first.text_key", "copies"))
    # the representative's own row has the signature: no need to aggregate the arrays
    classes = (signed.where("digest is not null").join(copies, ["digest", "doc_id", "text_key"]).dropDuplicates(["digest", "doc_id", "text_key"])
               .select(F.monotonically_increasing_id().alias("rep"), "digest", "doc_id", "text_key", "copies", "n_shingles", "sig").checkpoint())
    ties, length = candidate_ties(classes, threshold, trees, depth, floor, target)
    comps = connected_components(ties, "rep", "least", "rep", "comp")
    rows = _prefixes(classes.join(comps, "rep"), length, trees, depth).select(
        "rep", "doc_id", "text_key", "copies", "n_shingles", "keys", "comp", common.vertex("doc_id", F.hex("digest")).alias("vertex")).checkpoint()
    sizes = rows.groupBy("comp").agg(F.ceil(F.greatest(
        F.sum("n_shingles") / TILE_SHINGLES, F.count(F.lit(1)) / TILE_ROWS)).cast("int").alias("tiles"))
    rows = rows.join(sizes, "comp")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [shingles(np.frombuffer(_CHUNKS.words(t), np.uint64), n).tobytes() for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "shingles", pa.array(found, pa.binary()))

    texts = docs.join(rows.hint("shuffle_hash"), ["doc_id", "text_key"]).select(
        "comp", "tiles", "rep", "copies", "keys", "vertex", "text")
    texts = texts.mapInArrow(sets, "comp long, tiles int, rep long, copies long, keys array<long>, vertex string, shingles binary")
    side = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    tiled = texts.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("comp", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "rep", "copies", "side", "keys", "vertex", "shingles")
    found = (tiled.repartition(parts, "comp", "x", "y").sortWithinPartitions("comp", "x", "y", "rep")
             .mapInArrow(_verify(Fraction(threshold).limit_denominator(10_000), trees), "rep long, links long, vertex string, root string").checkpoint())
    # components of one tile are whole already; those of several are joined by their roots.  The smallest
    # vertex is the smallest id's class, so nothing is looked up per component
    whole = connected_components(found.select("vertex", "root"), "vertex", "root", "vertex", "least")
    links = found.groupBy("vertex").agg(F.sum("links").alias("links"))
    own = classes.select("digest", "copies", common.vertex("doc_id", F.hex("digest")).alias("vertex"))
    result = own.join(links, "vertex", "left").join(whole, "vertex", "left").select(
        "digest", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "vertex").alias("least"))
    linked = join_classes(named, result, ["digest"], "doc_id").select(
        "doc_id", "text_key", "n_links", common.first_id("least").alias("class_id"), (common.vertex("doc_id", F.hex("digest")) == F.col("least")).alias("kept"))
    alone = members.where("digest is null").select("doc_id", "text_key")
    alone = alone.where("doc_id is null").unionByName(
        alone.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_key").alias("text_key"))).select(
        "doc_id", "text_key", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_links, class_id, kept``: one row per document of ``docs(doc_id, text)``.

    ``n_links``: other documents with the same words or a shingle similarity of at least ``threshold``;
    ``class_id``: the smallest id reachable by links; ``kept``: whether the document stands for all that
    it reaches.  Words are runs of word characters in lower case.  Documents without words link with
    nothing; fewer than n words are one shingle.  Rows that repeat an id and its words are one document;
    an id with several texts is a document, and has a row, for each of them: its texts' groups stay
    apart, and of several texts of one id in the same group one is kept.  Rows without id link with
    nothing, have no class and are kept.  An empty table gives no rows; other columns are not read.
    ``options``: those of ``_decisions``."""
    return _decisions(docs, **options).select("doc_id", "n_links", "class_id", "kept")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) whose document stands for its class, one row per id and class
    of texts; rows without id stay."""
    kept = _decisions(docs, **options).where("kept and doc_id is not null").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    chosen = docs.join(kept, (F.col("doc_id") == F.col("_kept_id")) & (_text_key() == F.col("_kept_key")))
    return chosen.dropDuplicates(["_kept_id", "_kept_key"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
