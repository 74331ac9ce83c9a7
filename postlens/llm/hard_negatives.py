"""Operator 11: hard negatives by lists that clusters of anchors share.

Anchors are clustered by direction.  For a cluster with centre c and angular radius r, no member can
score a candidate x higher than |anchor| |x| cos(max(0, angle(x, c) - r)).  Candidates are sorted by this
bound once per cluster; every member walks that list from its head and stops, certified, where the bound
times its own norm falls below what it still needs.

A list is never held whole.  Clusters lie in groups of similar centres; a candidate first goes to the
group of its nearest centre, which gives every anchor a first, valid threshold.  Then it goes to those
other groups of which some cluster cannot rule it out.  What is left out lies beyond the certified end of
every member's walk.  Groups are cut into slices of anchors and tiles of candidates, so neither a hot
direction nor a hot label fills a task; per slice and tile the walk is the same, and the few best of each
tile are merged.

Positives (same label) are found first; each distinct positive score opens a window of allowed scores,
and the second search fills the windows with rows of other labels.  Equal vectors with equal label are
one class: all its rows have one score, so no list can name more than its first few ids, and anchors of
one class share their search.

Directions without clusters give weak bounds; the walks then get as long as the lists.  That is inherent
to an exact search: the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.session import checkpoint_dir

POSITIVES, NEGATIVES = 5, 5
#: Per cent of the positive's score that a negative's score may have, at least and at most.
LOW, HIGH = 80, 100
#: Anchors a cluster is meant to hold; clusters at most and bytes of centres (broadcast) at most; clusters of a group.
CLUSTER_ANCHORS, MAX_CLUSTERS, LEADER_BYTES, GROUP_CLUSTERS = 32, 16_384, 32_000_000, 64
#: Anchors of a slice, candidates of a tile, cells of a block of scores.
SLICE, TILE, CELLS = 2_048, 8_192, 2_000_000
#: Needs for positives are kept per cluster and hash of the label.
LABEL_HASHES = 64
SCALE = 256.0
_FLOOR, _CEILING = -(1 << 63), (1 << 63) - 1
#: Above the rounding errors of a bound, relative to the candidate's norm.
_SLACK = 1e-7

ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("anchor", pa.bool_()), ("cls", pa.binary()), ("vector", pa.binary())])
FOUND = pa.schema([("cls", pa.binary()), ("p", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("pcls", pa.binary())])
_FOUND_DDL = "cls binary, p long, score long, vec_id long, pcls binary"


# ------------------------------------------------------------------------------ vectors

def _quantise(dim: int):
    """Whole numbers in the narrowest integer type, padded with zeros to ``dim``; the class is a digest of
    label and vector.  Rows with null or non-finite components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Collector(ROWS)
        for batch in batches:
            for vec_id, label, anchor, values in common.rows_of(batch, "vec_id", "label", "anchor", "embedding"):
                if None in values:
                    continue
                v = np.array(values, np.float64)
                if not np.isfinite(v).all():
                    continue
                v = np.floor(SCALE * v)
                if float(v @ v) >= 2.0 ** 62:
                    raise ValueError(f"vec_id {vec_id}: the inner products of this vector do not fit a long")
                most = np.abs(v).max(initial=0)
                kind = "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<i8"
                whole = np.zeros(dim, kind)
                whole[:v.size] = v.astype(kind)
                raw = whole.tobytes()
                cls = hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest()
                if out.add(vec_id, label, anchor, cls, raw):
                    yield from out.flush()
        yield from out.flush()
    return run


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Rows of quantised vectors as int64."""
    x = np.zeros((len(raw), dim), np.int64)
    sizes = np.array([len(r) for r in raw])
    for width, kind in ((2, "<i2"), (4, "<i4"), (8, "<i8")):
        at = np.flatnonzero(sizes == width * dim)
        if dim and at.size:
            x[at] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), kind).reshape(at.size, dim)
    return x


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, unit vectors); zero vectors stay zero."""
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    return norm, x / np.where(norm > 0, norm, 1.0)[:, None]


# ------------------------------------------------------------------------------ clusters of anchors

def _bisect(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in groups of at most ``most``, halved along the direction in which they differ most."""
    groups, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= most:
            groups.append(at)
            continue
        way = np.linalg.svd(x[at] - x[at].mean(0), full_matrices=False)[2][0]
        order = at[np.argsort(x[at] @ way, kind="stable")]
        todo += [order[len(order) // 2:], order[:len(order) // 2]]
    return groups


def _centres(sample: np.ndarray, k: int, rounds: int = 3) -> np.ndarray:
    """Spherical k-means of unit vectors from the first k distinct ones."""
    first = np.sort(np.unique(sample, axis=0, return_index=True)[1])[:k]
    centres = sample[first]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i:i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(1))
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


class Clusters:
    """Centres in the order of their groups, ``starts`` of the groups, and the cosines of the radii."""

    def __init__(self, centres: np.ndarray, group_clusters: int):
        groups = _bisect(centres, group_clusters)
        self.centres = centres[np.concatenate(groups)]
        self.starts = np.cumsum([0, *map(len, groups)])[:-1]
        self.group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        self.cos = np.ones(len(centres))

    def bounds(self, unit: np.ndarray, norm: np.ndarray, at=slice(None)) -> np.ndarray:
        """|x| cos(max(0, angle to the centre - radius)) for rows x and the clusters ``at``."""
        c = np.clip(unit @ self.centres[at].T, -1, 1)
        r = self.cos[at]
        away = c * r + np.sqrt(1 - c * c) * np.sqrt(np.maximum(0, 1 - r * r))
        return norm[:, None] * np.where(c >= r, 1.0, away)


def _cluster(queries: DataFrame, dim: int, cluster_anchors: int, group_clusters: int) -> Clusters:
    """From a bounded sample of the anchors."""
    n = queries.count()
    k = max(1, min(-(-n // cluster_anchors), MAX_CLUSTERS, LEADER_BYTES // (8 * max(1, dim))))
    share = int(min(1.0, 4 * k / max(1, n)) * 1_000_000) + 1
    rows = queries.where(F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < share).orderBy("cls").limit(8 * k).select("vector").collect()
    unit = _units(_matrix([bytes(r["vector"]) for r in rows], dim))[1]
    unit = unit[(unit != 0).any(1)] if dim else unit[:0]
    return Clusters(_centres(unit, k) if len(unit) else np.zeros((1, dim)), group_clusters)


def _assign(model, dim: int):
    """Adds each row's nearest cluster and its group, its norm and the cosine to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("vector")).to_pylist(), dim)
            norm, unit = _units(x)
            near, cos = np.zeros(len(x), np.int64), np.ones(len(x))
            for i in range(0, len(x), 1024):
                c = unit[i:i + 1024] @ m.centres.T
                near[i:i + 1024] = c.argmax(1)
                cos[i:i + 1024] = c.max(1)
            cos = np.where(norm > 0, cos, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32()), pa.array(m.group[near], pa.int32()), pa.array(norm), pa.array(cos)],
                names=[*batch.schema.names, "cluster", "grp", "norm", "cos"])
    return run


def _beyond(model, needs, same: bool, dim: int):
    """Groups, the candidate's own left out, with a cluster that cannot rule the candidate out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, need = model.value, needs.value
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("vector")).to_pylist(), dim)
            own = batch.column(batch.schema.get_field_index("grp")).to_numpy()
            hashed = batch.column(batch.schema.get_field_index("lh")).to_numpy()
            norm, unit = _units(x)
            groups: list[list[int]] = []
            for i in range(0, len(x), 1024):
                part = slice(i, i + 1024)
                least = need[:, hashed[part]].T if same else need.min(1)[None, :]
                open_ = m.bounds(unit[part], norm[part]) + _SLACK * norm[part, None] >= least
                some = np.logical_or.reduceat(open_, m.starts, axis=1)
                some[np.arange(len(some)), own[part]] = False
                groups += [np.flatnonzero(row).tolist() for row in some]
            kept = [n for n in batch.schema.names if n not in ("grp", "lh")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept),
                                              pa.array(groups, pa.list_(pa.int32()))], names=[*kept, "grps"])
    return run


# ------------------------------------------------------------------------------ the walk

def walk_list(x: np.ndarray, same: np.ndarray, bound: np.ndarray, slack: float, q: np.ndarray, norm: np.ndarray,
              member: np.ndarray, lows: np.ndarray, highs: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows ``(member, low, high)`` of one cluster's members walk the candidates ``x`` in the order of
    ``bound``.  ``same[i, j]``: may member i take candidate j?  Returns (window, score, candidate) of the
    ``keep`` best of each window, ties by candidate, and leaves a window where the bound falls below its
    lowest useful score."""
    order = np.argsort(-bound, kind="stable")
    need, live = lows.copy(), np.flatnonzero(lows <= highs)
    win, score, cand = np.zeros(0, np.int64), np.zeros(0, x.dtype), np.zeros(0, np.int64)
    at = 0
    while at < len(order) and live.size:
        reach = norm[member[live]] * (bound[order[at]] + slack) + 1e-6
        live = live[reach >= need[live]]
        if not live.size:
            break
        step = int(min(4096, max(64, CELLS // live.size)))
        cols = order[at:at + step]
        at += step
        some, place = np.unique(member[live], return_inverse=True)
        s = (q[some] @ x[cols].T)[place]
        hit = same[np.ix_(some, cols)][place] & (s >= need[live, None]) & (s <= highs[live, None])
        a, b = np.nonzero(hit)
        if not a.size:
            continue
        win, score, cand = np.concatenate([win, live[a]]), np.concatenate([score, s[a, b]]), np.concatenate([cand, cols[b]])
        best = np.lexsort((cand, -score, win))
        win, score, cand = win[best], score[best], cand[best]
        first = np.searchsorted(win, win)                       # where each window begins
        kept = np.arange(len(win)) - first < keep
        win, score, cand = win[kept], score[kept], cand[kept]
        full = np.flatnonzero(np.arange(len(win)) - np.searchsorted(win, win) == keep - 1)
        need[win[full]] = np.maximum(need[win[full]], score[full])
    return win, score, cand


def _walk(model, same: bool, keep: int, dim: int):
    """A slice of a group's anchors against a tile of candidates."""

    def run(anchors: pa.Table, points: pa.Table) -> pa.Table:
        out = common.Collector(FOUND)
        if anchors.num_rows and points.num_rows:
            m = model.value
            ids, classes = points["vec_id"].to_pylist(), points["cls"].to_pylist()
            by_id = sorted(range(len(ids)), key=lambda i: (ids[i], classes[i]))          # ties fall by position
            ids, classes = [ids[i] for i in by_id], [classes[i] for i in by_id]
            raw, names = points["vector"].to_pylist(), points["label"].to_pylist()
            x, q = _matrix([raw[i] for i in by_id], dim), _matrix(anchors["vector"].to_pylist(), dim)
            (size, unit), (norm, _) = _units(x), _units(q)
            kind = np.float64 if max(size.max(), norm.max()) ** 2 < 2.0 ** 53 else np.int64
            x, q = x.astype(kind), q.astype(kind)
            codes = np.unique(anchors["label"].to_pylist() + [names[i] for i in by_id], return_inverse=True)[1]
            of, label = codes[:len(q)], codes[len(q):]
            cluster = anchors["cluster"].to_numpy()
            keys, ps, lows, highs = (anchors[c].to_pylist() for c in ("cls", "ps", "lows", "highs"))
            for c in np.unique(cluster).tolist():
                members = np.flatnonzero(cluster == c)
                bound = m.bounds(unit, size, slice(c, c + 1))[:, 0]
                slack = _SLACK * float(size.max())
                for part in np.array_split(members, -(-len(members) // 256)):
                    windows = [(k, p, lo, hi) for k, i in enumerate(part.tolist()) for p, lo, hi in zip(ps[i], lows[i], highs[i])]
                    if not windows:
                        continue
                    who = np.array([w[0] for w in windows])
                    allowed = (of[part][:, None] == label[None, :]) == same
                    found = walk_list(x, allowed, bound, slack, q[part], norm[part], who, np.array([w[2] for w in windows], kind),
                                      np.array([w[3] for w in windows], kind), keep)
                    for w, s, j in zip(*(f.tolist() for f in found)):
                        out.add(keys[part[windows[w][0]]], windows[w][1], int(s), ids[j], classes[j])
        return pa.Table.from_batches(out.flush(), FOUND)
    return run


def _tiles(queries: DataFrame, points: DataFrame, model, same: bool, keep: int, dim: int, tile: int) -> DataFrame:
    """Walks of every group's slices over the tiles of the points sent there (``grps``); merged."""
    spread = points.withColumn("grp", F.explode("grps")).drop("grps")
    shape = (spread.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
             .join(queries.groupBy("grp").agg((F.max("slice") + 1).alias("slices")), "grp").checkpoint())   # a row per group
    p = (spread.join(F.broadcast(shape), "grp").withColumn("tile", F.pmod(F.xxhash64("cls", "vec_id"), F.col("tiles")).cast("int"))
         .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("grp", "slice", "tile", "vec_id", "label", "cls", "vector"))
    q = (queries.join(F.broadcast(shape), "grp").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
         .select("grp", "slice", "tile", "cls", "label", "vector", "cluster", "ps", "lows", "highs"))
    found = q.groupBy("grp", "slice", "tile").cogroup(p.groupBy("grp", "slice", "tile")).applyInArrow(_walk(model, same, keep, dim), _FOUND_DDL)
    return _best(found, keep)


def _best(found: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("cls", "p").orderBy(F.desc("score"), "vec_id", "pcls")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def _search(queries: DataFrame, points: DataFrame, model, same: bool, keep: int, dim: int, tile: int) -> DataFrame:
    """``cls, p, score, vec_id, pcls``: the ``keep`` best of each window, exactly."""
    spark = queries.sparkSession
    queries = queries.checkpoint()
    first = _tiles(queries, points.withColumn("grps", F.array("grp")).drop("grp"), model, same, keep, dim, tile).checkpoint()
    if len(model.value.starts) < 2:
        return first
    # what a window still needs: its keep-th score so far
    full = (first.groupBy("cls", "p").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= keep)
            .groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("p", "s"))).alias("got")))        # a few windows
    queries = queries.join(full, "cls", "left").withColumn("lows", F.when(F.col("got").isNull(), F.col("lows")).otherwise(
        F.zip_with("ps", "lows", lambda p, lo: F.greatest(lo, F.coalesce(F.try_element_at("got", p), lo))))).drop("got").checkpoint()
    open_ = queries.select("cluster", "norm", F.pmod(F.xxhash64("label"), F.lit(LABEL_HASHES)).cast("int").alias("lh"),
                           F.explode(F.arrays_zip("lows", "highs")).alias("w")).where("w.lows <= w.highs")
    needs = np.full((len(model.value.centres), LABEL_HASHES), np.inf)
    for r in open_.groupBy("cluster", "lh").agg(F.min(F.when(F.col("norm") > 0, F.col("w.lows") / F.col("norm")).otherwise(
            F.lit(float("-inf")))).alias("need")).collect():    # at most MAX_CLUSTERS x LABEL_HASHES numbers
        needs[r["cluster"], r["lh"]] = r["need"] - 1e-6 * (1 + abs(r["need"])) if np.isfinite(r["need"]) else r["need"]
    reach = points.withColumn("lh", F.pmod(F.xxhash64("label"), F.lit(LABEL_HASHES)).cast("int")).mapInArrow(
        _beyond(model, spark.sparkContext.broadcast(needs), same, dim), "vec_id long, label string, cls binary, vector binary, grps array<int>")
    more = _tiles(queries, reach.where(F.size("grps") > 0).checkpoint(), model, same, keep, dim, tile)
    return _best(first.unionByName(more), keep).checkpoint()


def _per_cent(p: Column, share: int, up: bool) -> Column:
    """share per cent of a whole number, rounded up or down, in whole numbers throughout."""
    rest = F.pmod(p, F.lit(100))
    part = rest * share + (99 if up else 0)
    return F.call_function("div", p - rest, F.lit(100)) * share + F.call_function("div", part, F.lit(100))


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                        cluster_anchors: int = CLUSTER_ANCHORS, group_clusters: int = GROUP_CLUSTERS, slice_rows: int = SLICE, tile: int = TILE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of
    ``vectors(vec_id, embedding, label)``; ``is_anchor`` is a condition on its columns.

    Scores are inner products of the vectors' components times 256, rounded down.  An anchor's positives
    are its ``positives`` best other rows of the same label; for each, the ``negatives`` best rows of other
    labels with low·positive ≤ 100·negative ≤ high·positive follow, ranked from 1.  Ties go to the smaller
    vec_id (then to a digest of label and vector).  Rows with a null id, label or vector or with a null or
    non-finite component take no part; shorter vectors count as padded with zeros, zero and empty ones
    score 0.  Rows repeating id, label and vector are one row; different rows of one id stay apart, and
    each of them may be an anchor and each other's positive or negative.  An anchor without positives or
    without fitting negatives gives no rows, an empty table none; other columns are not read.  Inner
    products of 2**62 and more raise an error."""
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    base = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", F.coalesce(is_anchor, F.lit(False)).alias("anchor")
                          ).where("vec_id is not null and label is not null and embedding is not null")
    dim = base.agg(F.max(F.size("embedding"))).first()[0] or 0
    ddl = "vec_id long, label string, anchor boolean, cls binary, vector binary"
    rows = base.mapInArrow(_quantise(dim), ddl).dropDuplicates(["vec_id", "cls"]).checkpoint()
    ids = max(positives + 1, negatives)
    in_class = Window.partitionBy("cls").orderBy("vec_id")       # limited before the shuffle
    points = rows.withColumn("_n", F.row_number().over(in_class)).where(F.col("_n") <= ids).select("vec_id", "label", "cls", "vector")
    anchors = rows.where("anchor").select(F.col("vec_id").alias("anchor_id"), "cls").distinct()
    queries = rows.where("anchor").select("cls", "label", "vector").dropDuplicates(["cls"]).checkpoint()

    clusters = _cluster(queries, dim, cluster_anchors, group_clusters)
    model = spark.sparkContext.broadcast(clusters)
    extra = ", cluster int, grp int, norm double, cos double"
    queries = queries.mapInArrow(_assign(model, dim), "cls binary, label string, vector binary" + extra).checkpoint()
    for r in queries.groupBy("cluster").agg(F.min("cos").alias("cos")).collect():                 # at most MAX_CLUSTERS rows
        clusters.cos[r["cluster"]] = max(-1.0, r["cos"] - 1e-9)
    model = spark.sparkContext.broadcast(clusters)
    slices = queries.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    queries = (queries.join(F.broadcast(slices), "grp").withColumn("slice", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
               .drop("slices", "cos").checkpoint())
    points = (points.mapInArrow(_assign(model, dim), "vec_id long, label string, cls binary, vector binary" + extra)
              .drop("cluster", "norm", "cos").checkpoint())

    longs = "array<long>"
    found = _search(queries.withColumn("ps", F.array(F.lit(0)).cast(longs)).withColumn("lows", F.array(F.lit(_FLOOR)).cast(longs))
                    .withColumn("highs", F.array(F.lit(_CEILING)).cast(longs)), points, model, True, positives + 1, dim, tile)
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "pcls")))   # positives + 1 entries
    near = found.groupBy("cls").agg(best.alias("near"))
    windows = near.withColumn("ps", F.array_distinct(F.transform("near", lambda e: -e["s"])))
    windows = windows.select("cls", "near", "ps", F.transform("ps", lambda p: _per_cent(p, low, True)).alias("lows"),
                             F.transform("ps", lambda p: _per_cent(p, high, False)).alias("highs")).checkpoint()
    hard = _search(queries.join(windows.drop("near"), "cls"), points, model, False, negatives, dim, tile)
    hard = (hard.groupBy("cls", "p").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "pcls"))).alias("hard"))
            .groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("p", "hard"))).alias("hard")))
    # a class with very many anchors meets its lists in several tasks
    salts = 16
    lists = windows.select("cls", "near").join(hard, "cls").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = anchors.withColumn("salt", F.pmod(F.xxhash64("anchor_id"), F.lit(salts)).cast("int")).join(lists, ["cls", "salt"])
    own = F.filter("near", lambda e: (e["vec_id"] != F.col("anchor_id")) | (e["pcls"] != F.col("cls")))
    each = named.select("anchor_id", "hard", F.explode(F.slice(own, 1, positives)).alias("pos"))
    each = each.select("anchor_id", "pos", F.posexplode(F.try_element_at("hard", -F.col("pos.s"))).alias("at", "neg"))
    return each.select("anchor_id", F.col("pos.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                       F.col("neg.vec_id").alias("negative_id"), (-F.col("pos.s")).alias("positive_score"), (-F.col("neg.s")).alias("negative_score"))
