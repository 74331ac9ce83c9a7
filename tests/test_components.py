"""Connected components against union-find: a shuffled path, a star, a chain of cliques, text ids."""

import random

import pytest

from postlens.operators.components import connected_components


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((v, find(v)) for v in parent)


def path(n):
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    return list(zip(ids, ids[1:]))


GRAPHS = {
    "path": path(8000),
    "ordered_path": [(i, i + 1) for i in range(600)],
    "star": [(0, i) for i in range(1, 500)] + [(1000 + i, 900) for i in range(50)],
    "mixed": [(random.Random(i).randrange(400), random.Random(i + 1).randrange(400)) for i in range(300)] + [(7, 7), (901, 901)],
}


@pytest.mark.parametrize("name,finish", [("path", 2000), ("path", 50_000), ("ordered_path", 50), ("star", 0), ("mixed", 0), ("mixed", 50_000)])
def test_components(spark, name, finish):
    edges = spark.createDataFrame(GRAPHS[name], "a long, b long")
    assert sorted(map(tuple, connected_components(edges, "a", "b", finish_edges=finish).collect())) == union_find(GRAPHS[name])


def test_text_ids_and_nulls(spark):
    edges = [("p10", "p9"), ("p9", "p1"), ("x", None), ("z", "y")]
    got = connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    assert sorted(map(tuple, got)) == union_find([("p10", "p9"), ("p9", "p1"), ("z", "y")])
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
