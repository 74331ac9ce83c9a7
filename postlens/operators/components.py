"""Connected components by contraction.

Each round every vertex points at its smallest neighbour (or itself); pointer jumping turns these
pointers into stars, whose centres stand for the next round's vertices; edges are relabelled, loops
and doubles fall away.  Every vertex that still has an edge is merged with at least one other, so the
vertices halve each round and the loop ends only when no edge is left — there is no round limit.
Smallest neighbours come from partial aggregates and label look-ups are joins with a unique side, so
a vertex with very many neighbours is no hot task.  Tables are cut off by ``checkpoint()``.  Once a
contracted graph has at most ``FINISH_EDGES`` edges, one task finishes it with a union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.session import checkpoint_dir

FINISH_EDGES = 50_000


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges → each vertex's smallest reachable vertex."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for frame in frames:
        for x, y in zip(frame["_a"], frame["_b"]):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"_v": list(parent), "_p": [find(x) for x in list(parent)]})


def _jump(pointers: DataFrame) -> DataFrame:
    """``_v, _p`` forest of pointers to smaller vertices → each vertex's root."""
    while True:
        ahead = pointers.where("_v != _p").select(F.col("_v").alias("_p"), F.col("_p").alias("_q"))
        step = (pointers.join(ahead, "_p", "left")
                .select("_v", F.coalesce("_q", "_p").alias("_p"), F.col("_q").isNotNull().alias("_moved")).checkpoint())
        if step.where("_moved").limit(1).count() == 0:
            return step.select("_v", "_p")
        pointers = step.select("_v", "_p")


def connected_components(edges: DataFrame, a: str, b: str, vertex: str = "vertex", component: str = "component",
                         finish_edges: int = FINISH_EDGES) -> DataFrame:
    """``(vertex, component)`` of every vertex in an undirected edge list; the component is its
    smallest vertex.  Loops count as edges of a vertex to itself; null ends are ignored; any ordered
    id type will do; no edges give no rows."""
    checkpoint_dir(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a is not null and _b is not null")
    both = pairs.union(pairs.select("_b", "_a")).distinct().checkpoint()
    labels = both.select(F.col("_a").alias("_v"), F.col("_a").alias("_c")).distinct()
    both = both.where("_a != _b")
    while n := both.count():
        if n <= finish_edges:
            kind = both.schema["_a"].dataType.simpleString()
            roots = both.coalesce(1).mapInPandas(_finish, f"_v {kind}, _p {kind}")
        else:
            nearest = both.groupBy(F.col("_a").alias("_v")).agg(F.min("_b").alias("_p"))
            roots = _jump(nearest.select("_v", F.least("_v", "_p").alias("_p")).checkpoint())
        labels = (labels.join(roots.withColumnRenamed("_v", "_c"), "_c", "left")
                  .select("_v", F.coalesce("_p", "_c").alias("_c")).checkpoint())
        if n <= finish_edges:
            break
        one = both.join(roots.select(F.col("_v").alias("_a"), F.col("_p").alias("_x")), "_a").select(F.col("_x").alias("_a"), "_b")
        both = (one.join(roots.select(F.col("_v").alias("_b"), F.col("_p").alias("_x")), "_b").select("_a", F.col("_x").alias("_b"))
                .where("_a != _b").distinct().checkpoint())
    return labels.select(F.col("_v").alias(vertex), F.col("_c").alias(component))
