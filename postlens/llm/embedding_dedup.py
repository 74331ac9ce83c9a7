"""Operator 9: embedding near-duplicates by a robust-pruned flat graph.

Vectors are compared within a label.  Equal vectors of a label form a class, numbered on its own: an id
that stands on several vectors belongs to several classes, which have nothing to do with each other.
Leaders — a bounded sample of vectors, none close to another — define cluster shards, and every vector
goes to its ``overlap`` nearest shards.  In each shard a flat graph is built by greedy insertion with
robust pruning; the adjacency lists that a vector got in its shards are united, with the reverse edges
where they are searched.  Then every vector searches its shards: greedily from the shard's medoid (and
its own neighbours), and from all nodes in range on to their neighbours until no more are in range.
Whatever is found is verified by the cosine in double precision.  A pair that meets in several shards
counts in the first that both share.

Recall is audited twice, both times on a bounded number of vectors.  Planted copies — of sampled vectors,
one, a few or many of each, at cosines from the threshold on — go through shards, graphs and searches
like all others; how many of the links among a vector's planted copies are found is known evidence on
any table, however rare its own copies are.  (Planted vectors count in no result and join no
components.)  And a sample of the table's own vectors is compared with all rows.  Recall is the mean of
the vectors' own; while either falls below ``target``, the overlap grows, to all shards if need be, and
if that is not enough all pairs are compared.

Shards of more than ``TILE_ROWS`` rows are cut into tiles: a graph per tile, searched by the vectors
of every tile of the shard, so a large group of near copies is split over tasks and loses no link.
Tasks return one row per class — links and local component — never pairs.  Leaders are bounded in bytes;
labels beyond that bound are one shard, cut into tiles and searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.operators.components import connected_components
from postlens.operators.joins import join_classes
from postlens.session import checkpoint_dir

THRESHOLD = 0.98
#: Vectors a shard is meant to hold, rows of a tile, and bytes of leaders (broadcast) at most.
SHARD_ROWS, TILE_ROWS, LEADER_BYTES = 800, 1_200, 32_000_000
#: Leaders closer than this cosine would split a group of near copies.
LEADER_COSINE = 0.8
DEGREE, BEAM, ALPHA = 24, 32, 1.2
#: Nodes up to this much below the threshold are walked through (not linked).
SLACK = 0.02
OVERLAPS, TARGET = (2, 3, 5), 0.99
#: Sampled vectors that are compared with all rows; planted copies: (sampled vectors, copies of each).
AUDIT_ROWS, PLANTED = 200, ((200, 1), (80, 6), (20, 40))
_HASHES = 1 << 40

ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("digest", pa.binary()), ("vector", pa.binary())])


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as float64 bytes; null where they can link with nothing."""
    out = common.Collector(ROWS)
    for batch in batches:
        for vec_id, label, values in common.rows_of(batch, "vec_id", "label", "embedding"):
            v = np.array(values, np.float64) if values else np.zeros(0)
            ok = vec_id is not None and label is not None and v.size and None not in values and np.isfinite(v).all() and (v != 0).any()
            raw = (v + 0.0).tobytes() if ok else None           # -0.0 equals 0.0
            group = f"{label}/{v.size}" if ok else None         # other lengths are not comparable
            if out.add(vec_id, group, hashlib.blake2b(raw, digest_size=16).digest() if ok else None, raw):
                yield from out.flush()
    yield from out.flush()


def unit(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, norms, unit vectors); scaled first, so that no norm over- or underflows."""
    v = np.stack([np.frombuffer(r, np.float64) for r in raw])
    v = v / np.abs(v).max(1, keepdims=True)
    norm = np.sqrt((v * v).sum(1))
    return v, norm, v / norm[:, None]


class FlatGraph:
    """Adjacency lists over the rows of a matrix of unit vectors; distance: 1 - dot product."""

    def __init__(self, x: np.ndarray, neighbours: list[list[int]] | None = None):
        self.x = x
        self.medoid = int(np.argmax(x @ x.mean(0))) if len(x) else 0
        self.neighbours = neighbours if neighbours is not None else [[] for _ in x]

    def build(self, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> "FlatGraph":
        order = np.random.default_rng(seed).permutation(len(self.x))
        for p in [self.medoid] + [int(i) for i in order if i != self.medoid]:
            nodes, _ = self.search(self.x[p], beam, skip=p)
            self.neighbours[p] = self.prune(p, nodes, degree, alpha)
            for q in self.neighbours[p]:
                near = self.neighbours[q]
                near.append(p)
                if len(near) > degree + degree // 2:
                    self.neighbours[q] = self.prune(q, np.array(near), degree, alpha)
        return self

    def symmetric(self) -> "FlatGraph":
        """Adds every edge's reverse.  Pruning leaves many near copies on a single node in their midst,
        whose own list is too short for all of them; the reverse edges lead back to each."""
        back: list[list[int]] = [[] for _ in self.x]
        for i, near in enumerate(self.neighbours):
            for j in near:
                back[j].append(i)
        self.neighbours = [list(dict.fromkeys(a + b)) for a, b in zip(self.neighbours, back)]
        return self

    def prune(self, p: int, nodes: np.ndarray, degree: int, alpha: float) -> list[int]:
        """Nearest first; a kept node drops those that are alpha times nearer to it than to p."""
        nodes = np.unique(nodes)
        nodes = nodes[nodes != p]
        away = 1 - self.x[nodes] @ self.x[p]
        order = np.argsort(away, kind="stable")
        nodes, away, kept = nodes[order], away[order], []
        while nodes.size and len(kept) < degree:
            kept.append(int(nodes[0]))
            stay = alpha * (1 - self.x[nodes] @ self.x[nodes[0]]) > away
            stay[0] = False
            nodes, away = nodes[stay], away[stay]
        return kept

    def search(self, q: np.ndarray, beam: int = BEAM, skip: int = -1, start: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """All nodes met on the greedy way from the medoid, and their dot products with q."""
        seen = {skip}
        fresh = [s for s in dict.fromkeys((self.medoid, *start)) if s not in seen]
        nodes, dots, expanded = np.zeros(0, np.int64), np.zeros(0), set()
        while fresh:
            seen.update(fresh)
            nodes = np.concatenate([nodes, fresh])
            dots = np.concatenate([dots, self.x[fresh] @ q])
            top = nodes[np.argpartition(-dots, beam - 1)[:beam]] if nodes.size > beam else nodes
            near = [i for i in top.tolist() if i not in expanded]
            expanded.update(near)
            fresh = list({j for i in near for j in self.neighbours[i]} - seen)
        return nodes, dots

    def in_range(self, q: np.ndarray, least: float, slack: float = SLACK, beam: int = BEAM, skip: int = -1,
                 start: tuple[int, ...] = ()) -> np.ndarray:
        """Nodes with a dot product of about ``least`` or more: greedy search, then from every node in
        range (with slack) on to its neighbours."""
        nodes, dots = self.search(q, beam, skip, start)
        seen = set(nodes.tolist()) | {skip}
        hits = [nodes[dots >= least - 1e-9]]
        edge = nodes[dots >= least - slack].tolist()
        while edge:
            fresh = list({j for i in edge for j in self.neighbours[i]} - seen)
            if not fresh:
                break
            seen.update(fresh)
            nodes = np.array(fresh)
            dots = self.x[nodes] @ q
            hits.append(nodes[dots >= least - 1e-9])
            edge = nodes[dots >= least - slack].tolist()
        return np.concatenate(hits)


def pick_leaders(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of unit vectors none of which has LEADER_COSINE or more with an earlier one."""
    kept, n = np.empty((min(most, len(x)), x.shape[1])), 0
    for at in range(0, len(x), 512):
        block = x[at:at + 512]
        block = block[(block @ kept[:n].T).max(1, initial=-1.0) < LEADER_COSINE]      # against the leaders before this block
        first = n
        for row in block:
            if n == len(kept):
                return kept
            if n == first or (kept[first:n] @ row).max() < LEADER_COSINE:
                kept[n] = row
                n += 1
    return kept[:n]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]):
    """Rows of sorted partitions, one group at a time."""
    current, rows = None, []
    for batch in batches:
        for row in common.rows_of(batch, *keys, *columns):
            if row[:len(keys)] != current:
                if rows:
                    yield current, rows
                current, rows = row[:len(keys)], []
            rows.append(row[len(keys):])
    if rows:
        yield current, rows


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A graph per (label, shard, tile): each vector's neighbours as ids."""
    out = common.Collector(pa.schema([("rep", pa.int64()), ("near", pa.list_(pa.int64()))]))
    for _, rows in _groups(batches, ("label", "shard", "tile"), ("rep", "vector")):
        ids = [r[0] for r in rows]
        graph = FlatGraph(unit([r[1] for r in rows])[2]).build()
        for i, near in zip(ids, graph.neighbours):
            if out.add(i, [ids[j] for j in near]):
                yield from out.flush()
    yield from out.flush()


def _search(threshold: float, exact_pairs: bool = False):
    """Links between tiles x and y of a shard, counted where the shard is the first that both share;
    with ``exact_pairs`` all pairs are compared, without the graph.  ``base`` is a planted copy's vector (a
    class's own number otherwise): pairs of one base count as ``planted``, other pairs with a planted copy
    (negative numbers) not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Collector(pa.schema([(c, pa.int64()) for c in ("rep", "first", "links", "planted", "root", "root_first")]))
        for (_, shard, x, y), rows in _groups(batches, ("label", "shard", "x", "y"), ("rep", "copies", "tile", "shards", "near", "vector", "first", "base")):
            ids, n = [r[0] for r in rows], len(rows)
            first, base = [r[6] for r in rows], [r[7] for r in rows]
            copies, shards = np.array([r[1] for r in rows], np.int64), [set(r[3]) for r in rows]
            raw, norm, u = unit([r[5] for r in rows])
            tile = np.array([r[2] for r in rows])
            home = np.flatnonzero(tile == x)                  # the graph of tile x
            place = {ids[i]: k for k, i in enumerate(home.tolist())}
            others = np.arange(n) if x == y else np.flatnonzero(tile == y)
            pairs = set()
            if exact_pairs:
                a, b = np.nonzero(u[others] @ u[home].T >= threshold - 1e-9)
                pairs = {(min(p), max(p)) for p in zip(others[a].tolist(), home[b].tolist()) if p[0] != p[1]}
            else:
                graph = FlatGraph(u[home], [[place[j] for j in rows[i][4] if j in place] for i in home.tolist()]).symmetric()
            for q in others.tolist() if home.size and not exact_pairs else ():
                own = place.get(ids[q], -1)
                start = tuple(graph.neighbours[own] if own >= 0 else (place[j] for j in rows[q][4] if j in place))
                for k in graph.in_range(u[q], threshold, skip=own, start=start).tolist():
                    pairs.add((min(q, int(home[k])), max(q, int(home[k]))))
            if not pairs:
                continue
            a, b = np.array(sorted(pairs)).T
            exact = (raw[a] * raw[b]).sum(1) / (norm[a] * norm[b]) >= threshold
            a, b = a[exact], b[exact]
            links, planted, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), list(range(n))

            def find(v):
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v
            for i, j in zip(a.tolist(), b.tolist()):
                if min(shards[i] & shards[j]) != shard:
                    continue
                if ids[i] < 0 or ids[j] < 0:
                    if base[i] == base[j]:
                        planted[i] += ids[i] < 0
                        planted[j] += ids[j] < 0
                    continue
                links[i] += copies[j]
                links[j] += copies[i]
                p, r = find(i), find(j)
                parent[max(p, r)] = min(p, r)
            least: dict[int, tuple[int, int]] = {}
            for i in np.flatnonzero(links).tolist():
                r = find(i)
                least[r] = min(least.get(r, (first[i], ids[i])), (first[i], ids[i]))
            for i in np.flatnonzero(links + planted).tolist():
                root_first, root = least.get(find(i), (first[i], ids[i]))
                if out.add(ids[i], first[i], int(links[i]), int(planted[i]), root, root_first):
                    yield from out.flush()
        yield from out.flush()
    return run


def _assign(leaders: dict[str, np.ndarray], overlap: int):
    """The nearest shards of each vector, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            raw = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            shards: list[list[int]] = [[0]] * len(labels)
            for label in set(labels):
                x = leaders.get(label)
                if x is not None and len(x) > 1:
                    at = [i for i, name in enumerate(labels) if name == label]
                    near = np.argsort(-(unit([raw[i] for i in at])[2] @ x.T), axis=1, kind="stable")[:, :overlap]
                    for i, s in zip(at, np.sort(near, axis=1).tolist()):
                        shards[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int64()))], names=[*batch.schema.names, "shards"])
    return run


def choose_leaders(classes: DataFrame, shard_rows: int, leader_bytes: int) -> dict[str, np.ndarray]:
    """Leaders of the labels with more than a shard of vectors, the largest first; the sample, two vectors
    a label at least, is bounded by leader_bytes."""
    sizes = {r["label"]: r["count"] for r in classes.groupBy("label").count().where(F.col("count") > shard_rows)
             .orderBy(F.desc("count"), "label").limit(leader_bytes // 128).collect()}
    if not sizes:
        return {}
    want = {g: -(-n // shard_rows) for g, n in sizes.items()}
    size = sum(k * 8 * int(g.rpartition("/")[2]) for g, k in want.items())
    part = min(1.0, leader_bytes / (2 * size))
    shares = classes.sparkSession.createDataFrame(
        [(g, int(min(1.0, 2 * k * part / sizes[g]) * 1_000_000) + 1) for g, k in want.items()], "label string, share long")
    rows = (classes.join(F.broadcast(shares), "label")        # bounded by leader_bytes
            .where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < F.col("share")).select("label", "rep", "vector").orderBy("label", "rep").collect())
    found: dict[str, list[bytes]] = {}
    for r in rows:
        found.setdefault(r["label"], []).append(bytes(r["vector"]))
    return {g: pick_leaders(unit(raw)[2], max(2, want[g])) for g, raw in found.items()}


def _planted(classes: DataFrame, threshold: float) -> tuple[DataFrame | None, dict[int, int]]:
    """Copies of a bounded sample of vectors, numbered from -1 downwards, and how many links each has with
    its vector and that vector's other copies."""
    want = sum(n for n, _ in PLANTED)
    n = classes.count()
    part = int(min(1.0, 2 * want / max(1, n)) * _HASHES) + 1
    bases = (classes.where(F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(_HASHES)) < part).orderBy(F.xxhash64("rep", F.lit(2)), "rep")
             .limit(want).select("rep", "label", "vector").collect())
    rng, rows, there = np.random.default_rng(17), [], {}
    counts = [k for n, k in PLANTED for _ in range(n)]
    # few vectors: every kind of group among them
    counts = counts if len(bases) >= want else [PLANTED[i % len(PLANTED)][1] for i in range(len(bases))]
    for base, k in zip(bases, counts):
        u = unit([bytes(base["vector"])])[2][0]
        if u.size < 2:
            continue
        away = rng.normal(size=(k, u.size))
        away -= np.outer(away @ u, u)
        away /= np.sqrt((away * away).sum(1, keepdims=True))
        cos = rng.uniform(threshold, 1.0, (k, 1)) + 1e-9
        x = np.concatenate([u[None], np.minimum(cos, 1) * u + np.sqrt(np.maximum(0, 1 - cos * cos)) * away])
        _, norm, _ = unit([r.tobytes() for r in x])
        near = unit([r.tobytes() for r in x])[2]
        linked = (near @ near.T >= threshold).sum(1) - 1
        for r, links in zip(x[1:], linked[1:].tolist()):
            number = -1 - len(there)
            there[number] = links
            rows.append((number, number, base["rep"], 0, base["label"], bytearray(r.tobytes())))
    if not rows:
        return None, {}
    return classes.sparkSession.createDataFrame(rows, "rep long, first long, base long, copies long, label string, vector binary"), there


def _planted_recall(found: DataFrame, there: dict[int, int]) -> float:
    got = {r["rep"]: r["n"] for r in found.where("rep < 0").groupBy("rep").agg(F.sum("planted").alias("n")).collect()}   # bounded by PLANTED
    some = {k: n for k, n in there.items() if n}
    return sum(min(1.0, got.get(k, 0) / n) for k, n in some.items()) / len(some) if some else 1.0


def _audit(classes: DataFrame, found: DataFrame, threshold: float, rows: int) -> float:
    """Mean over about ``rows`` sampled vectors of the links found over the links there are, by brute force
    over all rows; without any link there, 1."""
    n = classes.count()
    part = int(min(1.0, rows / max(n, 1)) * _HASHES) + 1
    sample = (classes.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(_HASHES)) < part).orderBy(F.xxhash64("rep", F.lit(1)), "rep")
              .limit(2 * rows).select("rep", "label", "vector").collect())
    if not sample:
        return 1.0
    names = classes.sparkSession.createDataFrame([(r["rep"],) for r in sample], "rep long")
    links = found.join(F.broadcast(names), "rep", "left_semi").groupBy("rep").agg(F.sum("links").alias("links"))
    row = _count_links(classes, sample, threshold).join(links, "rep", "left").agg(F.count(F.lit(1)).alias("n"), F.sum(
        F.least(F.coalesce("links", F.lit(0)) / F.col("there"), F.lit(1.0))).alias("recalls")).first()
    return row["recalls"] / row["n"] if row["n"] else 1.0


def _count_links(classes: DataFrame, sample: list, threshold: float) -> DataFrame:
    """``rep, there``: the links of each vector of the sample that has any, compared with all rows."""
    queries: dict[str, list] = {}
    for r in sample:
        queries.setdefault(r["label"], []).append((r["rep"], bytes(r["vector"])))
    queries = {g: (np.array([i for i, _ in q]), unit([v for _, v in q])) for g, q in queries.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {g: np.zeros(len(ids), np.int64) for g, (ids, _) in queries.items()}
        for batch in batches:
            by: dict[str, list] = {}
            for rep, copies, label, vector in common.rows_of(batch, "rep", "copies", "label", "vector"):
                if label in queries:
                    by.setdefault(label, []).append((rep, copies, vector))
            for label, rows in by.items():
                ids, (raw, norm, _) = queries[label]
                for k in range(0, len(rows), 1_000):          # bounded memory
                    part = rows[k:k + 1_000]
                    x, size, _ = unit([v for _, _, v in part])
                    hit = (raw @ x.T) / (norm[:, None] * size[None, :]) >= threshold
                    hit &= ids[:, None] != np.array([r for r, _, _ in part])[None, :]
                    total[label] += hit @ np.array([c for _, c, _ in part], np.int64)
        for label, (ids, _) in queries.items():
            some = total[label] > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(total[label][some], pa.int64())], names=["rep", "there"])

    return classes.select("rep", "copies", "label", "vector").mapInArrow(count, "rep long, there long").groupBy("rep").agg(F.sum("there").alias("there"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, overlaps: tuple[int, ...] = OVERLAPS,
                           target: float = TARGET, leader_bytes: int = LEADER_BYTES, report: dict | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null, their lengths are equal and the cosine is at
    least ``threshold``.  Null, empty and zero vectors and those with null or non-finite components link
    with nothing; rows without id neither (component null, kept).  Equal vectors of a label link with each
    other; rows repeating an id, its label and its vector are one.  An id with several vectors or labels
    has a row for each, with that vector's own links and component: ``n_links`` counts linked vectors (of
    the same id too), ``component_id`` is the smallest id reachable from that vector.  An empty table gives
    no rows; other columns are not read.  ``report`` receives the audited recalls (``planted``,
    ``recall``) and the overlap used (0: all pairs were compared)."""
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    parts = common.partitions(spark)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(
        _valid, "vec_id long, label string, digest binary, vector binary").checkpoint()
    valid = rows.where("digest is not null")
    named = valid.select("vec_id", "label", "digest").distinct()
    copies = named.groupBy("label", "digest").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    vector = valid.groupBy("label", "digest").agg(F.first("vector").alias("vector"))           # equal within a class
    numbered = copies.join(vector, ["label", "digest"]).withColumn("rep", F.monotonically_increasing_id()).checkpoint()
    classes = numbered.select("rep", "first", F.col("rep").alias("base"), "copies", "label", "vector")
    planted, there = _planted(classes, threshold)
    searched = classes if planted is None else classes.unionByName(planted)
    leaders = choose_leaders(classes, shard_rows, leader_bytes)
    most = max(map(len, leaders.values()), default=1)
    steps = [*overlaps]
    while steps[-1] < most:
        steps.append(2 * steps[-1])
    carried = "rep long, first long, base long, copies long, label string, vector binary, shards array<long>"
    for overlap in [*(o for k, o in enumerate(steps) if not k or steps[k - 1] < most), 0]:
        sharded = searched.mapInArrow(_assign(leaders if overlap else {}, overlap), carried).checkpoint()
        placed = sharded.withColumn("shard", F.explode("shards"))
        sizes = placed.groupBy("label", "shard").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("tiles"))
        placed = placed.join(sizes, ["label", "shard"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).checkpoint()
        near = (placed.select("label", "shard", "tile", "rep", "vector").repartition(parts, "label", "shard", "tile")
                .sortWithinPartitions("label", "shard", "tile", "rep").mapInArrow(_build, "rep long, near array<long>"))
        near = near.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))   # overlap × degree ids
        linked = placed.join(near, "rep") if overlap else placed.withColumn("near", F.array().cast("array<long>"))
        tiled = linked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.select("label", "shard", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"),
                             "rep", "first", "base", "copies", "tile", "shards", "near", "vector")
        found = (tiled.repartition(parts, "label", "shard", "x", "y").sortWithinPartitions("label", "shard", "x", "y", "rep").mapInArrow(
            _search(threshold, not overlap), "rep long, first long, links long, planted long, root long, root_first long").checkpoint())
        audits = {"planted": _planted_recall(found, there), "recall": _audit(classes, found, threshold, AUDIT_ROWS) if overlap else 1.0}
        if report is not None:
            report.update(audits, overlap=overlap, leaders={g: len(x) for g, x in leaders.items()})
        if min(audits.values()) >= target:
            break
    found = found.where("rep >= 0 and links > 0")
    # the smallest class of a component is that of its smallest id: nothing is looked up per component
    whole = connected_components(found.select(
        common.vertex("first", F.lpad(F.col("rep").cast("string"), 20, "0")).alias("a"),
        common.vertex("root_first", F.lpad(F.col("root").cast("string"), 20, "0")).alias("b")), "a", "b", "v", "c")
    whole = whole.select(F.substring("v", 21, 20).cast("long").alias("rep"), common.first_id("c").alias("component_id"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = numbered.select("rep", "label", "digest", "first", "copies").join(links, "rep", "left").join(whole, "rep", "left").select(
        "label", "digest", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    linked = join_classes(valid.select("vec_id", "label", "digest"), result, ["label", "digest"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
