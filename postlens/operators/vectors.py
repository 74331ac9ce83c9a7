"""Vector operators: unit vectors, text embeddings, exact k-nearest
neighbours, intrinsic dimension, k-distance elbow, k-means search, PCA and centroid similarity.

Exact kNN without an all-pairs product: equal vectors are collapsed to one point; points are assigned
to k-means cells; each query compares itself only with the points of its ``probe`` nearest cells, then
a certification pass uses the triangle inequality — a cell whose centroid distance minus its radius
exceeds the current k-th distance cannot hold a closer point — and searches every cell it cannot rule
out.  The result equals brute force; the work is the candidate cells, not n².  The cell model
(centroids and radii) is a broadcast whose size is bounded: there are as many cells as fit
``MAX_MODEL_BYTES``, and fuller cells are searched in tiles.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.operators.sampling import exact_rank, positive_bucket
from postlens.session import checkpoint_dir

MAX_MODEL_BYTES = 64 * 1024 * 1024


def as_double_array(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, v: s + v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """H1 (normalise step): the vector divided by its L2 norm (zero vectors unchanged)."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector has no direction (norm 0)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


# ---------------------------------------------------------------- H1: text embeddings

def embed_text(df: DataFrame, col: str = "content", dim: int = 256, out_col: str = "embedding") -> DataFrame:
    """H1: tokens → hashed term frequencies → IDF → L2-normalised vector (``ARRAY<DOUBLE>``).
    An external encoder can be plugged in instead with ``pyspark.ml.functions.predict_batch_udf``."""
    tok = RegexTokenizer(inputCol=col, outputCol="_tok", pattern=r"[\p{L}\p{N}_#]+", gaps=False,
                         toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    x = tf.transform(tok.transform(df.where(F.col(col).isNotNull())))
    idf = IDF(inputCol="_tf", outputCol="_tfidf").fit(x)
    y = Normalizer(inputCol="_tfidf", outputCol="_n", p=2.0).transform(idf.transform(x))
    return y.withColumn(out_col, vector_to_array("_n")).drop("_tok", "_tf", "_tfidf", "_n")


# ---------------------------------------------------------------- D9: exact kNN

def _matrix(column):
    """Vectors of a table as the rows of a matrix."""
    import numpy as np
    parts = [c for c in column.chunks if len(c)]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in parts]).astype(np.float64, copy=False)


def _as_lists(qid, sizes, distance, rid):
    """``_qid, _l``: a row per query with its ``sizes`` next entries of ``distance`` and ``rid``, queries without any left out."""
    import numpy as np
    import pyarrow as pa
    some = sizes > 0
    ends = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(distance, pa.float64()), rid], names=["distance", "_rid"])
    return pa.table({"_qid": qid.filter(pa.array(some)), "_l": pa.ListArray.from_arrays(pa.array(ends), pairs)})


def _whole(column):
    """A column as one array."""
    import pyarrow as pa
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _lists_type(q: DataFrame, ref: DataFrame) -> str:
    return f"_qid {q.schema['_qid'].dataType.simpleString()}, _l array<struct<distance:double,_rid:{ref.schema['_rid'].dataType.simpleString()}>>"


def _tile_topk(k: int, self_join: bool):
    """Per tile: the exact k nearest reference rows of each query row, ties by id.  A matrix product
    picks candidates; their distances are computed again from the differences."""
    import numpy as np

    def exact(q, r):
        diff = r - q
        return np.sqrt(np.einsum("...j,...j->...", diff, diff))

    def run(qp, rp):
        names, ids = _whole(qp["_qid"]), _whole(rp["_rid"])
        if not len(names) or not len(ids):
            return _as_lists(names, np.zeros(len(names), np.int64), [], ids[:0])
        qid, rid = names.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
        by_id = np.argsort(rid, kind="stable")                # positions are then in the order of ids
        rid = rid[by_id]
        Q, R = _matrix(qp["_qv"]), _matrix(rp["_rv"])[by_id]
        rr, n = (R * R).sum(1), len(R)
        m = min(n, k + 1 + 8)                                 # the point itself and some for rounding
        out = []
        step = max(1, 4_000_000 // n)
        for s0 in range(0, len(Q), step):
            q = Q[s0:s0 + step]
            qq = (q * q).sum(1)
            near = qq[:, None] + rr - 2 * (q @ R.T)
            pick = np.argpartition(near, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (len(q), 1))
            pick.sort(axis=1)
            away = exact(q[:, None, :], R[pick])
            if self_join:
                away[rid[pick] == qid[s0:s0 + step, None]] = np.inf
            order = np.argsort(away, axis=1, kind="stable")[:, :k]
            top, dist = np.take_along_axis(pick, order, 1), np.take_along_axis(away, order, 1)
            # more rows as near as the k-th than were picked: take all of them into account
            slack = 1e-9 * (qq + rr.max()) + 1e-300
            reach = np.where(np.isfinite(dist[:, -1]), dist[:, -1] ** 2 + slack, np.inf)
            for i in np.flatnonzero((near <= reach[:, None]).sum(1) > m).tolist() if m < n else ():
                all_ = np.flatnonzero(near[i] <= reach[i])
                d = exact(q[i], R[all_])
                if self_join:
                    d[rid[all_] == qid[s0 + i]] = np.inf
                o = np.argsort(d, kind="stable")[:k]
                top[i, :len(o)], dist[i, :len(o)] = all_[o], d[o]
            ok = np.isfinite(dist)
            out.append((ok.sum(1), by_id[top[ok]], dist[ok]))
        sizes, which, dist = map(np.concatenate, zip(*out))
        return _as_lists(names, sizes, dist, ids.take(which))
    return run


def _nearest_of(n, distance, place, rank, k: int):
    """The k nearest of rows' candidates (``n`` of each row in turn), ties by ``rank[place]``."""
    import numpy as np
    inside = np.arange(n.max(initial=0)) < n[:, None]
    away, places = np.full(inside.shape, np.inf), np.zeros(inside.shape, np.int64)
    away[inside], places[inside] = distance, place
    order = np.argsort(away, axis=1)
    away, places = np.take_along_axis(away, order, 1), np.take_along_axis(places, order, 1)
    for row in np.flatnonzero(((away[:, 1:] == away[:, :-1]) & inside[:, 1:])[:, :k].any(1)).tolist():
        mine, d = places[row, :n[row]], away[row, :n[row]]
        places[row, :n[row]] = mine[np.lexsort((rank[mine], d))]
    n = np.minimum(n, k)
    inside = inside[:, :k] & (np.arange(min(k, inside.shape[1])) < n[:, None])
    return n, places[:, :k][inside], away[:, :k][inside]


def _tile_bound(k: int, self_join: bool):
    """Per tile: a distance within which each query has k reference rows (none where the tile holds fewer)."""
    import numpy as np
    import pyarrow as pa

    def run(qp, rp):
        names, bounds, m = _whole(qp["_qid"]), [], k + int(self_join)              # the point itself may be among them
        n = len(rp)
        if not len(names) or n < m:
            return pa.table({"_qid": names[:0], "_bound": pa.array([], pa.float64())})
        Q, R = _matrix(qp["_qv"]), _matrix(rp["_rv"])
        rr, step = (R * R).sum(1), max(1, 4_000_000 // n)
        for s0 in range(0, len(Q), step):
            q = Q[s0:s0 + step]
            qq = (q * q).sum(1)
            near = np.partition(rr - 2 * (q @ R.T), m - 1, axis=1)[:, m - 1] + qq
            bounds.append(np.sqrt(np.maximum(near, 0) + 1e-9 * (qq + rr.max()) + 1e-300))
        return pa.table({"_qid": names, "_bound": pa.array(np.concatenate(bounds))})
    return run


def _tile_search(q: DataFrame, ref: DataFrame, tile: int, run, kind: str) -> DataFrame:
    """Compare every (query, cell) row with the reference points of that cell, in tiles of at
    most ``tile`` × ``tile`` rows: a cell with many queries or many points is split on both sides
    (salting), so no task holds a whole hot cell.  ``run`` gets queries and points of a tile."""
    qn = q.groupBy("_cell").agg(F.count(F.lit(1)).alias("_nq"))
    rn = ref.groupBy("_cell").agg(F.count(F.lit(1)).alias("_nr"))
    splits = qn.join(rn, "_cell").select(
        "_cell", F.ceil(F.col("_nq") / tile).cast("int").alias("_sq"),
        F.ceil(F.col("_nr") / tile).cast("int").alias("_sr"))
    qs = (q.join(splits, "_cell")
          .withColumn("_tq", F.pmod(F.xxhash64("_qid"), F.col("_sq")).cast("int"))
          .withColumn("_tr", F.explode(F.sequence(F.lit(0), F.col("_sr") - 1)))
          .select("_cell", "_tq", "_tr", "_qid", "_qv"))
    rs = (ref.join(splits, "_cell")
          .withColumn("_tr", F.pmod(F.xxhash64("_rid"), F.col("_sr")).cast("int"))
          .withColumn("_tq", F.explode(F.sequence(F.lit(0), F.col("_sq") - 1)))
          .select("_cell", "_tq", "_tr", "_rid", "_rv"))
    return (qs.groupBy("_cell", "_tq", "_tr").cogroup(rs.groupBy("_cell", "_tq", "_tr"))
            .applyInArrow(run, kind))


def _cells(ref: DataFrame, n_cells: int, seed: int):
    """k-means cells of the reference vectors: (reference with ``_cell``, centroids, radii)."""
    import numpy as np
    if n_cells < 2:
        row = corpus_centroid(ref, "_rv").first()["centroid"]
        centers = np.array([list(row)]) if row is not None else np.zeros((1, 0))
        placed = ref.withColumn("_cell", F.lit(0))
    else:
        # cells only need to be compact, not converged: a few Lloyd rounds from random centres
        km = KMeans(k=n_cells, seed=seed, maxIter=5, initMode="random", featuresCol="_fv", predictionCol="_cell")
        model = km.fit(ref.select(array_to_vector("_rv").alias("_fv")))
        centers = np.stack(model.clusterCenters())
        placed = model.transform(ref.withColumn("_fv", array_to_vector("_rv"))).drop("_fv")
    ctab = ref.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "_cell INT, _c ARRAY<DOUBLE>")
    radii = np.full(len(centers), -np.inf)                    # a cell without points holds nothing near
    for r in (placed.join(F.broadcast(ctab), "_cell").groupBy("_cell")        # at most MAX_MODEL_BYTES
              .agg(F.max(dist(F.col("_rv"), F.col("_c"))).alias("_r")).collect()):
        radii[r["_cell"]] = r["_r"]
    return placed, centers, radii


def _visits(model, probe: int, certify: bool):
    """Queries → one row per cell to search: the ``probe`` nearest, or (certify) every other cell
    that can still hold a point as near as ``_bound``."""
    import numpy as np
    import pandas as pd

    def run(frames):
        centers, radii = model.value
        step = max(1, 16_384 // max(1, len(centers)))         # bounds the rows of a batch: a query may visit every cell
        for f in frames:
            for at in range(0, len(f), step):
                part = f.iloc[at:at + step]
                q = np.stack(part["_qv"].to_numpy()).astype(np.float64)
                d2 = (q * q).sum(1)[:, None] + (centers * centers).sum(1) - 2 * (q @ centers.T)
                d = np.sqrt(np.maximum(d2, 0.0))
                first = np.argsort(d, axis=1, kind="stable")[:, :probe]
                visit = np.zeros(d.shape, bool)
                np.put_along_axis(visit, first, True, 1)
                if certify:
                    scale = np.sqrt((q * q).sum(1))[:, None] + np.sqrt((centers * centers).sum(1))
                    visit = ~visit & (d - radii <= part["_bound"].to_numpy()[:, None] + 1e-7 * scale + 1e-12)
                i, cell = np.nonzero(visit)
                yield pd.DataFrame({"_qid": part["_qid"].to_numpy()[i], "_qv": part["_qv"].to_numpy()[i], "_cell": cell.astype("int32")})
    return run


#: Points of a block of cells, and bytes of their vectors, at most: what a task of the certification holds of each side.
BLOCK_POINTS, BLOCK_BYTES = 131_072, 96 * 1024 * 1024


def _blocks(placed: DataFrame, centers, radii, tile: int):
    """The cell model with its cells dealt to blocks of at most ``size`` points, neighbours along the main axis of
    the centres together: (centers, radii, first block of each cell, blocks of each cell, cells of each block),
    and ``size``.  A cell beyond ``size`` has several blocks of its own."""
    import numpy as np
    counts = np.zeros(len(centers), np.int64)
    for r in placed.groupBy("_cell").count().collect():       # at most as many as cells
        counts[r["_cell"]] = r["count"]
    # enough pairs of blocks for all cores, as long as blocks are no smaller than a tile
    wide = math.isqrt(3 * placed.sparkSession.sparkContext.defaultParallelism) + 1
    most = min(BLOCK_POINTS, BLOCK_BYTES // (8 * max(1, centers.shape[1])))
    size = max(tile, min(most, -(-int(counts.sum()) // wide)))
    around = np.nan_to_num(centers - centers.mean(0))
    axis = np.linalg.svd(around, full_matrices=False)[2][0] if around.size else np.zeros(centers.shape[1])
    first, parts, cells_of, room = np.zeros(len(centers), np.int64), np.ones(len(centers), np.int64), [], 0
    for c in np.argsort(around @ axis, kind="stable").tolist():
        n = int(counts[c])
        if n > size:
            first[c], parts[c], room = len(cells_of), -(-n // size), 0
            cells_of.extend([c] for _ in range(parts[c]))
        else:
            if not cells_of or n > room:
                cells_of.append([])
                room = size
            cells_of[-1].append(c)
            first[c], room = len(cells_of) - 1, room - n
    return (centers, radii, first, parts, [np.array(c) for c in cells_of]), size


def _block_visits(model, probe: int):
    """Queries → one row per block with cells that can still hold a point as near as ``_bound`` (``_mask``: which of
    the block's cells; the ``probe`` nearest are not among them)."""
    import numpy as np

    def run(frames):
        centers, radii, _, _, cells_of = model.value
        step = max(1, 1_000_000 // max(1, len(centers)))
        for f in frames:
            for at in range(0, len(f), step):
                part = f.iloc[at:at + step]
                q = np.stack(part["_qv"].to_numpy()).astype(np.float64)
                d2 = (q * q).sum(1)[:, None] + (centers * centers).sum(1) - 2 * (q @ centers.T)
                d = np.sqrt(np.maximum(d2, 0.0))
                visit = d - radii <= part["_bound"].to_numpy()[:, None] + 1e-7 * (
                    np.sqrt((q * q).sum(1))[:, None] + np.sqrt((centers * centers).sum(1))) + 1e-12
                np.put_along_axis(visit, np.argsort(d, axis=1, kind="stable")[:, :probe], False, 1)
                for block, cells in enumerate(cells_of):
                    some = np.flatnonzero(visit[:, cells].any(1))
                    if len(some):
                        masks = np.packbits(visit[np.ix_(some, cells)], axis=1)
                        yield part.iloc[some].assign(_cell=np.int32(block), _mask=[m.tobytes() for m in masks])
    return run


def _block_topk(model, k: int, apart: tuple[str, str] | None):
    """Per block: the exact k nearest points within ``_bound`` of each query, ties by id.  ``apart``: columns of query
    and point that must differ.  Cells are compared one by one by a matrix product and each lowers the bounds of its
    queries; what is left at the end is computed again from the differences."""
    import numpy as np
    import pandas as pd

    def run(key, qp, rp):
        names, ids = _whole(qp["_qid"]), _whole(rp["_rid"])
        if not len(names) or not len(ids):
            return _as_lists(names, np.zeros(len(names), np.int64), [], ids[:0])
        centers, radii, _, _, cells_of = model.value
        rid, at = ids.to_numpy(zero_copy_only=False), rp["_at"].to_numpy()
        by_id = np.argsort(rid, kind="stable")                # positions are then in the order of ids
        by_cell = by_id[np.argsort(at[by_id], kind="stable")]
        rank = np.empty(len(rid), np.int64)
        rank[by_id] = np.arange(len(rid))
        rank, at = rank[by_cell], at[by_cell]
        R = _matrix(rp["_rv"])[by_cell]
        rr_all = (R * R).sum(1)
        if apart:
            both = [qp[apart[0]].to_pandas().to_numpy(), rp[apart[1]].to_pandas().to_numpy()[by_cell]]
            codes = pd.factorize(np.concatenate(both))[0]
            qcode, rcode = codes[:len(names)], codes[len(names):]
        cells = cells_of[key[0].as_py()]
        masks = np.frombuffer(b"".join(qp["_mask"].to_pylist()), np.uint8).reshape(len(names), -1)
        Q, bounds, out = _matrix(qp["_qv"]), qp["_bound"].to_numpy(), []
        spans = [np.searchsorted(at, (c, c + 1)).tolist() for c in cells]
        for s0 in range(0, len(names), 1024):
            q = Q[s0:s0 + 1024]
            visit = np.unpackbits(masks[s0:s0 + 1024], axis=1, count=len(cells)).astype(bool)
            bound, qq = bounds[s0:s0 + 1024], (q * q).sum(1)
            slack = 1e-9 * (qq + rr_all.max()) + 1e-300
            reach = bound ** 2 + slack                        # of the matrix product's squares
            # candidates of a query side by side, places behind them empty
            near_of, place_of, held = np.full((len(q), 2 * k + 64), np.inf), np.zeros((len(q), 2 * k + 64), np.int32), np.zeros(len(q), np.int64)

            def settle(who):
                """The candidates within the k-th's square and the rounding, if there are k."""
                full = who[held[who] >= k]
                if not len(full):
                    return
                upto = int(held[full].max())
                values, places = near_of[full, :upto], place_of[full, :upto]
                reach[full] = np.minimum(reach[full], np.partition(values, k - 1, axis=1)[:, k - 1] + 2 * slack[full])
                i, j = np.nonzero(values <= reach[full, None])
                put(full, i, values[i, j], places[i, j], True)

            def put(who, i, values, places, anew=False):
                """Candidates of the queries ``who[i]`` (i ascending) behind those held, or in their place."""
                nonlocal near_of, place_of
                n = np.bincount(i, minlength=len(who))
                first = np.zeros(len(who), np.int64) if anew else held[who]
                if (most := int((first + n).max(initial=0))) > near_of.shape[1]:
                    more = ((0, 0), (0, most + k - near_of.shape[1]))
                    near_of, place_of = np.pad(near_of, more, constant_values=np.inf), np.pad(place_of, more)
                if anew:
                    near_of[who] = np.inf
                col = first[i] + np.arange(len(i)) - (np.cumsum(n) - n)[i]
                near_of[who[i], col], place_of[who[i], col] = values, places
                held[who] = first + n

            for m, c in enumerate(cells):
                lo, hi = spans[m]
                some = np.flatnonzero(visit[:, m])
                if lo == hi or not len(some):
                    continue
                away = np.sqrt(np.maximum(qq[some] + centers[c] @ centers[c] - 2 * (q[some] @ centers[c]), 0.0))
                some = some[away - radii[c] <= np.sqrt(reach[some]) + 1e-7 * (np.sqrt(qq[some]) + np.sqrt(centers[c] @ centers[c])) + 1e-12]
                step = max(1, 4_000_000 // (hi - lo))
                for t0 in range(0, len(some), step):
                    who = some[t0:t0 + step]
                    near = q[who] @ R[lo:hi].T
                    near *= -2
                    near += qq[who][:, None]
                    near += rr_all[lo:hi]
                    if apart:
                        near[qcode[s0 + who][:, None] == rcode[lo:hi]] = np.inf
                    fits = near <= reach[who][:, None]
                    many = np.flatnonzero(fits.sum(1) > k)
                    if len(many):                             # the k-th candidate bounds them as well
                        reach[who[many]] = np.minimum(reach[who[many]], np.partition(near[many], k - 1, axis=1)[:, k - 1] + 2 * slack[who[many]])
                        fits[many] = near[many] <= reach[who[many]][:, None]
                    i, j = np.nonzero(fits & (near < np.inf))
                    put(who, i, near[i, j], lo + j)
                    if len(i):
                        settle(who[held[who] > 2 * k])
            settle(np.arange(len(q)))
            i, col = np.nonzero(np.arange(near_of.shape[1]) < held[:, None])
            place = place_of[i, col]
            d = np.empty(len(i))
            for x in range(0, len(i), 4_000):                 # as many as a core's cache holds
                diff = R[place[x:x + 4_000]] - q[i[x:x + 4_000]]
                d[x:x + 4_000] = np.sqrt(np.einsum("...j,...j->...", diff, diff))
            ok = d <= bound[i] * (1 + 1e-12)
            n, place, d = _nearest_of(np.bincount(i[ok], minlength=len(q)), d[ok], place[ok], rank, k)
            out.append((n, by_cell[place], d))
        sizes, which, d = map(np.concatenate, zip(*out))
        return _as_lists(names, sizes, d, ids.take(which))
    return run


def _block_search(open_: DataFrame, placed: DataFrame, centers, radii, probe: int, k: int, tile: int,
                  apart: tuple[str, str] | None) -> DataFrame:
    """``_block_lists`` as rows ``_qid, _rid, distance``."""
    return _rows(_block_lists(open_, placed, centers, radii, probe, k, tile, apart))


def _block_lists(open_: DataFrame, placed: DataFrame, centers, radii, probe: int, k: int, tile: int,
                 apart: tuple[str, str] | None) -> DataFrame:
    """Queries (``_qid, _qv, _bound``) against every cell beyond their ``probe`` nearest that can hold a nearer point.
    A vector travels once per block of cells, not once per cell, and only points within the bound come back, a list
    per query and block."""
    layout, size = _blocks(placed, centers, radii, tile)
    spark = placed.sparkSession
    model = spark.sparkContext.broadcast(layout)
    kinds = [f"{c} {t}" for c, t in open_.dtypes]
    q = open_.mapInPandas(_block_visits(model, probe), ", ".join([*kinds, "_cell int", "_mask binary"]))
    splits = q.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_sq"))
    homes = spark.createDataFrame([(c, int(b), int(n)) for c, (b, n) in enumerate(zip(layout[2], layout[3]))], "_at int, _b int, _n int")
    qs = q.join(splits, "_cell").withColumn("_tq", F.pmod(F.xxhash64("_qid"), F.col("_sq")).cast("int")).drop("_sq")
    rs = (placed.withColumnRenamed("_cell", "_at").join(F.broadcast(homes), "_at")                 # as many as cells
          .withColumn("_cell", (F.col("_b") + F.pmod(F.xxhash64("_rid"), F.col("_n"))).cast("int")).drop("_b", "_n").join(splits, "_cell")
          .withColumn("_tq", F.explode(F.sequence(F.lit(0), F.col("_sq") - 1))).drop("_sq"))
    return (qs.groupBy("_cell", "_tq").cogroup(rs.groupBy("_cell", "_tq"))
            .applyInArrow(_block_topk(model, k, apart), _lists_type(open_, placed)))


def _rows(lists: DataFrame) -> DataFrame:
    return lists.select("_qid", F.explode("_l").alias("_e")).select("_qid", "_e._rid", "_e.distance")


#: Up to so many neighbours the nearest cells give lists at once; for more they give a bound only.
FEW_NEAREST = 32
#: Entries of the lists that a group of queries brings together, about.
MERGED = 1_000_000


def _merge(lists: DataFrame, k: int, queries: int) -> DataFrame:
    """A list of the k nearest per query from several lists, ties by id."""
    import numpy as np

    def run(part):
        ids, lists = _whole(part["_qid"]), _whole(part["_l"])
        pairs, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        found = ids.dictionary_encode()
        i = np.repeat(found.indices.to_numpy(), sizes)
        d, rid = pairs.field("distance").to_numpy(), pairs.field("_rid")
        by_query = np.argsort(i, kind="stable")
        n, place, d = _nearest_of(np.bincount(i, minlength=len(found.dictionary)), d[by_query], by_query, rid.to_numpy(zero_copy_only=False), k)
        return _as_lists(found.dictionary, n, d, rid.take(place))

    groups = max(1, min(queries, 4 * queries * k // MERGED))
    bucket = F.pmod(F.xxhash64("_qid"), F.lit(groups)).alias("_bucket")
    kind = ", ".join(f"{c} {t}" for c, t in lists.dtypes)
    return lists.groupBy(bucket).applyInArrow(run, kind)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_qid").orderBy("distance", "_rid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(q: DataFrame, ref: DataFrame, k: int, self_join: bool, cells: int | None, probe: int, seed: int,
             tile: int, report: dict | None) -> DataFrame:
    """``_qid, _l``: exactly the k nearest of ``ref(_rid, _rv)`` for ``q(_qid, _qv)`` as a list of ``distance, _rid``."""
    spark, queries = q.sparkSession, q.count()
    if cells is None:
        n = ref.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_rv")).alias("d")).first()
        # about half a tile of points per cell, at least 16 cells, as many as the model may have
        cells = max(1, min(max(16, 2 * n["n"] // tile), n["n"] // 8, MAX_MODEL_BYTES // (8 * max(1, n["d"] or 1))))
    placed, centers, radii = _cells(ref, cells, seed)
    placed = placed.checkpoint()                              # both rounds search it
    model = spark.sparkContext.broadcast((centers, radii))
    kind = f"_qid {q.schema['_qid'].dataType.simpleString()}, _qv array<double>, _cell int"
    near = q.mapInPandas(_visits(model, probe, False), kind)
    self_pair = ("_qid", "_rid") if self_join else None
    if k > FEW_NEAREST and report is None:
        bounds = _tile_search(near, placed, tile, _tile_bound(k, self_join), f"_qid {q.schema['_qid'].dataType.simpleString()}, _bound double")
        bounds = bounds.groupBy("_qid").agg(F.min("_bound").alias("_bound"))
        open_ = q.join(bounds, "_qid", "left").select("_qid", "_qv", F.coalesce("_bound", F.lit(float("inf"))).alias("_bound")).checkpoint()
        return _merge(_block_lists(open_, placed, centers, radii, 0, k, tile, self_pair), k, queries).checkpoint()
    first = _merge(_tile_search(near, placed, tile, _tile_topk(k, self_join), _lists_type(q, ref)), k, queries).checkpoint()
    kth = first.select("_qid", F.size("_l").alias("_n"), F.element_at("_l", -1)["distance"].alias("_dk"))
    open_ = q.join(kth, "_qid", "left").select("_qid", "_qv", F.when(F.col("_n") >= k, F.col("_dk")).otherwise(
        F.lit(float("inf"))).alias("_bound"))
    if report is not None:                                    # how many (query, point) pairs are compared, at most
        more = open_.mapInPandas(_visits(model, probe, True), kind)
        counts = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_m"))
        report["compared"] = near.unionByName(more).join(counts, "_cell").agg(F.sum("_m")).first()[0]
        report["cells"] = len(centers)
    more = _block_lists(open_, placed, centers, radii, probe, k, tile, self_pair)
    return _merge(first.unionByName(more), k, queries).checkpoint()


def knn(df: DataFrame, id_col: str, vec_col: str, k: int, query: DataFrame | None = None,
        cells: int | None = None, probe: int = 2, seed: int = 42, tile: int = 2048, report: dict | None = None) -> DataFrame:
    """The k nearest reference points of every query point (Euclidean), exact.

    ``query`` defaults to ``df`` itself (self-join, the point itself excluded).  Returns
    ``(id, neighbor, distance, rank)`` with ties broken by neighbour id.  Equal vectors are searched as
    one point that stands for its ids, so n reposts of one text give n·k rows.  Null vectors are left
    out.  ``report`` receives the number of cells and of compared pairs."""
    return list_rows(knn_lists(df, id_col, vec_col, k, query, cells, probe, seed, tile, report), id_col)


def list_rows(lists: DataFrame, id_col: str) -> DataFrame:
    """``knn_lists`` as the rows of ``knn``."""
    return (lists.select(id_col, F.posexplode("list").alias("_p", "_e"))
            .select(id_col, F.col("_e._rid").alias("neighbor"), F.col("_e.distance").alias("distance"), (F.col("_p") + 1).cast("long").alias("rank")))


def knn_lists(df: DataFrame, id_col: str, vec_col: str, k: int, query: DataFrame | None = None,
              cells: int | None = None, probe: int = 2, seed: int = 42, tile: int = 2048, report: dict | None = None) -> DataFrame:
    """``knn`` as ``(id, list)``, a row per query row with its ``list<struct<distance, _rid>>``, nearest first."""
    checkpoint_dir(df.sparkSession)
    self_join = query is None
    ids = df.select(F.col(id_col).alias("_id"), as_double_array(vec_col).alias("_v")).where("_id is not null and _v is not null")
    ids = ids.withColumn("_class", F.struct(F.xxhash64("_v"), F.sha2(F.to_json(F.struct("_v")), 256)))
    points = ids.groupBy("_class").agg(F.min("_id").alias("_rid"), F.first("_v").alias("_rv"), F.count(F.lit(1)).alias("_n")).checkpoint()
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max("_n").alias("most"), F.count_distinct("_rid").alias("ids")).first()
    if size["n"] == 0:
        kind = df.schema[id_col].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"{id_col} {(df if self_join else query).schema[id_col].dataType.simpleString()}, "
                                               f"list array<struct<distance:double,_rid:{kind}>>")
    ref = points.select("_rid", "_rv")
    if self_join:
        q = points.select(F.col("_rid").alias("_qid"), F.col("_rv").alias("_qv"))
    else:
        q = query.select(F.col(id_col).alias("_qid"), as_double_array(vec_col).alias("_qv")).where("_qid is not null and _qv is not null")
    near = _nearest(q, ref, k, self_join, cells, probe, seed, tile, report)
    if self_join and size["most"] == 1 and size["ids"] == size["n"]:              # every row is a point of its own
        return near.select(F.col("_qid").alias(id_col), F.col("_l").alias("list"))
    members = ids.join(points.select("_class", "_rid"), "_class").select("_rid", "_id")
    # the k + 1 smallest ids of each point: all that a list of k can name (salted, then merged)
    salted = Window.partitionBy("_rid", "_s").orderBy("_id")
    merged = Window.partitionBy("_rid").orderBy("_id")
    few = (members.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(64))).withColumn("_k", F.row_number().over(salted)).where(F.col("_k") <= k + 1)
           .withColumn("_k", F.row_number().over(merged)).where(F.col("_k") <= k + 1).select("_rid", "_id"))
    near = _rows(near)
    if self_join:
        near = near.unionByName(points.select(F.col("_rid").alias("_qid"), "_rid", F.lit(0.0).alias("distance")))
    lists = near.join(few, "_rid").select("_qid", "distance", F.col("_id").alias("_rid"))
    lists = _top(lists, k + 1).groupBy("_qid").agg(F.sort_array(F.collect_list(F.struct("distance", "_rid"))).alias("_l"))   # k + 1 entries
    if self_join:
        lists = (members.withColumnRenamed("_rid", "_qid").join(lists, "_qid")
                 .select(F.col("_id").alias("_qid"), F.filter("_l", lambda e: e["_rid"] != F.col("_id")).alias("_l")))
    return lists.select(F.col("_qid").alias(id_col), F.slice("_l", 1, k).alias("list"))


def nearest_elsewhere(df: DataFrame, id_col: str, vec_col: str, group_col: str, tile: int = 2048) -> DataFrame:
    """``(id, neighbor, distance)``: for every point the nearest point of another group (ties by id).
    Each group's points are queries against the points of all others, cell by cell: k-means cells are
    visited in the order of their lower bound only as long as they can hold a nearer point."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    x = df.select(F.col(id_col).alias("_rid"), as_double_array(vec_col).alias("_rv"), F.col(group_col).cast("string").alias("_g")).checkpoint()
    n = x.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_rv")).alias("d")).first()
    cells = max(1, min(max(16, 2 * n["n"] // tile), n["n"] // 8, MAX_MODEL_BYTES // (8 * max(1, n["d"] or 1))))
    placed, centers, radii = _cells(x, cells, 42)
    placed = placed.checkpoint()
    # a first bound: the distance to one point (the smallest id) of some other group, per cell of groups
    firsts = x.groupBy("_g").agg(F.min(F.struct("_rid", "_rv")).alias("_f"))
    two = firsts.orderBy("_g").limit(2).collect()
    if len(two) < 2:
        kind = df.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"{id_col} {kind}, neighbor {kind}, distance double")
    other = F.when(F.col("_qg") == two[0]["_g"], F.lit(two[1]["_f"]["_rv"])).otherwise(F.lit(two[0]["_f"]["_rv"]))
    q = placed.select(F.col("_rid").alias("_qid"), F.col("_rv").alias("_qv"), F.col("_g").alias("_qg"))
    bound = dist(F.col("_qv"), other)

    # own cell first for a tight bound, then every cell that can hold a nearer point
    own = _tile_elsewhere(placed.select("_cell", F.col("_rid").alias("_qid"), F.col("_rv").alias("_qv"), F.col("_g").alias("_qg")), placed, tile).checkpoint()
    best = own.groupBy("_qid").agg(F.min("distance").alias("_d"))
    open_ = q.join(best, "_qid", "left").select("_qid", "_qv", "_qg", F.least(F.coalesce("_d", bound), bound).alias("_bound"))
    found = own.unionByName(_block_search(open_, placed, centers, radii, 0, 1, tile, ("_qg", "_g")))
    top = found.groupBy("_qid").agg(F.min(F.struct("distance", "_rid")).alias("_m"))
    return top.select(F.col("_qid").alias(id_col), F.col("_m._rid").alias("neighbor"), F.col("_m.distance").alias("distance"))


def _tile_elsewhere(q: DataFrame, ref: DataFrame, tile: int) -> DataFrame:
    """Per tile of a cell: each query's nearest reference row of another group."""
    import numpy as np
    import pandas as pd

    def run(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = {"_qid": [], "_rid": [], "distance": []}
        if len(qp) and len(rp):
            rp = rp.sort_values("_rid", kind="stable")
            Q, R = (np.stack(c.to_numpy()).astype(np.float64) for c in (qp["_qv"], rp["_rv"]))
            rr, rid = (R * R).sum(1), rp["_rid"].to_numpy()
            groups, qg = rp["_g"].to_numpy(), qp["_qg"].to_numpy()
            step = max(1, 4_000_000 // len(R))
            for s0 in range(0, len(Q), step):
                q = Q[s0:s0 + step]
                qq = (q * q).sum(1)
                near = qq[:, None] + rr - 2 * (q @ R.T)
                near[qg[s0:s0 + step, None] == groups[None, :]] = np.inf
                for i in np.flatnonzero(np.isfinite(near).any(1)).tolist():
                    some = np.flatnonzero(near[i] <= near[i].min() + 1e-9 * (qq[i] + rr.max()))
                    d = np.sqrt(((R[some] - q[i]) ** 2).sum(1))
                    k = int(np.argmin(d))
                    out["_qid"].append(qp["_qid"].iloc[s0 + i])
                    out["_rid"].append(rid[some[k]])
                    out["distance"].append(float(d[k]))
        return pd.DataFrame(out).astype({"_qid": qp["_qid"].dtype, "_rid": rp["_rid"].dtype, "distance": "float64"})

    ref = ref.select(*(F.col(c).alias(c) for c in ("_cell", "_rid", "_rv", "_g")))     # both sides may stem from one table
    qn = q.groupBy("_cell").agg(F.count(F.lit(1)).alias("_nq"))
    rn = ref.groupBy("_cell").agg(F.count(F.lit(1)).alias("_nr"))
    splits = qn.join(rn, "_cell").select("_cell", F.ceil(F.col("_nq") / tile).cast("int").alias("_sq"), F.ceil(F.col("_nr") / tile).cast("int").alias("_sr"))
    qs = (q.join(splits, "_cell").withColumn("_tq", F.pmod(F.xxhash64("_qid"), F.col("_sq")).cast("int"))
          .withColumn("_tr", F.explode(F.sequence(F.lit(0), F.col("_sr") - 1))).select("_cell", "_tq", "_tr", "_qid", "_qv", "_qg"))
    rs = (ref.join(splits, "_cell").withColumn("_tr", F.pmod(F.xxhash64("_rid"), F.col("_sr")).cast("int"))
          .withColumn("_tq", F.explode(F.sequence(F.lit(0), F.col("_sq") - 1))).select("_cell", "_tq", "_tr", "_rid", "_rv", "_g"))
    kinds = f"_qid {q.schema['_qid'].dataType.simpleString()}, _rid {ref.schema['_rid'].dataType.simpleString()}, distance double"
    return qs.groupBy("_cell", "_tq", "_tr").cogroup(rs.groupBy("_cell", "_tq", "_tr")).applyInPandas(run, kinds)


def kth_distance(knn_df: DataFrame, id_col: str, k: int) -> DataFrame:
    """Distance to the k-th neighbour of every point (from a kNN table with at least k ranks)."""
    return knn_df.where(F.col("rank") == k).select(id_col, F.col("distance").alias("kdist"))


# ---------------------------------------------------------------- H2, H4

def _rank_values(df: DataFrame, value: str, id_col: str, common: float, by: list[str] | tuple = ()) -> DataFrame:
    """Exact ranks by value, in each group ``by``.  Order among equal values has no effect on the fits, so the value that
    copies share (``common``) is cut into buckets by a hash of the id: no rank task holds them all."""
    x = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(id_col), 48))
    v = F.col(value)
    bucket = F.struct(F.when(v > 0, positive_bucket(F.greatest(v, F.lit(1e-300)))).otherwise(F.lit(-1).cast("long")).alias("a"),
                      F.when(v == common, 1).when(v > common, 2).otherwise(0).alias("b"),
                      F.when(v == common, F.col("_h")).otherwise(F.lit(0).cast("long")).alias("c"))
    return exact_rank(x, [value, "_h", id_col], bucket, by, with_size=True).drop("_h")


def twonn_dimension(knn_df: DataFrame, id_col: str, discard: float = 0.1,
                    clip: tuple[int, int] = (5, 50)) -> DataFrame:
    """H2: TwoNN intrinsic dimension.  μ = r2/r1 sorted ascending; the largest ``discard`` share
    dropped; points whose nearest neighbour is at distance 0 have no ratio and are left out; d = Σ ln μ · (−ln(1 − i/N)) / Σ (ln μ)² (a line through the origin); the integer
    estimate is clip(round-half-even(d))."""
    r = knn_df.where(F.col("rank") <= 2).groupBy(id_col).agg(
        F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("r1"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("r2"))
    mu = r.where("r1 > 0").select(id_col, (F.col("r2") / F.col("r1")).alias("mu"))
    ranked = _rank_values(mu, "mu", id_col, 1.0)
    i = F.col("rank") - 1
    n = F.col("group_size")
    kept = ranked.where(i < F.floor(n * F.lit(1.0 - discard)))
    x = F.log(F.col("mu"))
    y = -F.log(F.lit(1.0) - i / n)
    out = kept.agg(F.try_divide(F.sum(x * y), F.sum(x * x)).alias("dimension"), F.first(n).alias("n"))
    return out.withColumn("intrinsic_dim",
                          F.least(F.greatest(F.bround("dimension", 0), F.lit(float(clip[0]))),
                                  F.lit(float(clip[1]))).cast("int"))


def elbow_sharpness(kdist: DataFrame, id_col: str, plateau: float = 0.8, cliff: float = 0.9, by: list[str] | tuple = ()) -> DataFrame:
    """H4: sort the k-distances; slope m1 over the first ``plateau`` share, slope m2 from the
    ``cliff`` share on; sharpness = m2 − m1 (the search maximises it).  ``by``: a row for each group."""
    ranked = _rank_values(kdist, "kdist", id_col, 0.0, by)
    x = (F.col("rank") - 1).cast("double")
    n = F.col("group_size")
    pe = F.floor(n * F.lit(plateau))
    cs = F.floor(n * F.lit(cliff))
    y = F.col("kdist")
    out = ranked.groupBy(*by).agg(F.regr_slope(F.when(x < pe, y), F.when(x < pe, x)).alias("m1"),
                                  F.regr_slope(F.when(x >= cs, y), F.when(x >= cs, x)).alias("m2"))
    return out.withColumn("sharpness", F.col("m2") - F.col("m1"))


# ---------------------------------------------------------------- H3, H8, H12

def reduce_dims(df: DataFrame, vec_col: str, k: int, out_col: str = "reduced",
                normalise: bool = True) -> DataFrame:
    """H3 (re-aimed): PCA to ``k`` components of the (optionally unit-length) vectors."""
    v = unit(as_double_array(vec_col)) if normalise else as_double_array(vec_col)
    x = df.withColumn("_fv", array_to_vector(v))
    model = PCA(k=k, inputCol="_fv", outputCol="_pc").fit(x)
    return model.transform(x).withColumn(out_col, vector_to_array("_pc")).drop("_fv", "_pc")


def kmeans_search(df: DataFrame, vec_col: str, k_min: int = 2, k_max: int = 10, seed: int = 42):
    """H8: k-means for every k in [k_min, k_max]; inertia and silhouette (Spark's silhouette
    uses squared Euclidean distance); best k = the first maximum silhouette.  Each fit is a
    distributed job; the loop over k runs on the driver.  Returns (scores, best model, best k)."""
    spark = df.sparkSession
    x = df.withColumn("_fv", array_to_vector(as_double_array(vec_col))).select("_fv").cache()
    ev = ClusteringEvaluator(featuresCol="_fv", predictionCol="_p", metricName="silhouette")
    rows, models = [], {}
    for k in range(k_min, k_max + 1):
        m = KMeans(k=k, seed=seed, featuresCol="_fv", predictionCol="_p").fit(x)
        sil = ev.evaluate(m.transform(x))
        rows.append((k, float(m.summary.trainingCost), float(sil)))
        models[k] = m
    x.unpersist()
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    scores = spark.createDataFrame(rows, "k INT, inertia DOUBLE, silhouette DOUBLE")
    return scores, models[best], best


def corpus_centroid(df: DataFrame, vec_col: str) -> DataFrame:
    """Mean vector of a table (one row, ``centroid``; none for an empty table), by a tree aggregate."""
    v = df.select(array_to_vector(as_double_array(vec_col)).alias("_fv"))
    return v.groupBy(F.lit(1)).agg(Summarizer.mean(F.col("_fv")).alias("_m")).select(vector_to_array("_m").alias("centroid"))


def centroid_similarity(df: DataFrame, id_col: str, vec_col: str, top: int | None = 50) -> DataFrame:
    """Cosine similarity of every candidate vector to the corpus centroid; top ``top``."""
    c = corpus_centroid(df, vec_col).withColumn("_one", F.lit(1))
    x = df.select(id_col, as_double_array(vec_col).alias("_v")).withColumn("_one", F.lit(1))
    sims = x.join(F.broadcast(c), "_one").select(id_col, cosine(F.col("_v"), F.col("centroid")).alias("similarity"))
    ordered = sims.orderBy(F.desc("similarity"), F.asc(id_col))
    return ordered.limit(top) if top else ordered
