"""The searches keep lists of neighbours; their scores are those of the edges."""
import random

import numpy as np
import pytest

from postlens.operators import cluster as CL
from postlens.operators import vectors as V


def _points(n=90):
    rng = random.Random(4)
    return [(i, [rng.gauss(9 * (i % 3), 0.7), rng.gauss(0, 0.7)]) for i in range(n)]


@pytest.mark.parametrize("mode", ["dbcv", "stability"])
def test_no_edges_are_written_where_ids_occur_once(spark, monkeypatch, mode):
    """Ids that are texts, and ids that occur twice, take the way by edges: the scores are the same."""
    grid, rows = (4, 15), [*_points(), (1000, None), (None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    texts = df.selectExpr("lpad(cast(id as string), 5, '0') id", "v")
    want = [tuple(r) for r in CL.search_parameters(texts, "id", "v", mode, grid)[0].collect()]
    assert max(r[2] for r in want) > 0
    monkeypatch.setattr(CL, "reachability_edges", None)       # written for every min_samples
    monkeypatch.setattr(CL, "LINKED", 30)
    got = [tuple(r) for r in CL.search_parameters(df, "id", "v", mode, grid)[0].collect()]
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_ids_that_occur_twice_take_the_way_by_edges(spark):
    grid = (4,)
    df = spark.createDataFrame(_points(40) + _points(40)[:5], "id long, v array<double>")
    nn = V.knn(df, "id", "v", 4).checkpoint()
    for ms, mcs, score in map(tuple, CL.search_parameters(df, "id", "v", "stability", grid)[0].collect()):
        cl = CL.density_cluster(df, "id", "v", ms, mcs, nn=nn).checkpoint()
        want = CL.validity(cl, nn.where(f"rank <= {ms - 1}"), "id", ms, "stability").first()["validity"]
        assert score == pytest.approx(want)


def test_all_elbows_of_a_grid_in_one_pass(spark, monkeypatch):
    df = spark.createDataFrame(_points(), "id long, v array<double>").checkpoint()
    grid = (3, 10, 40)
    want = [V.elbow_sharpness(V.kth_distance(V.knn(df, "id", "v", 40), "id", k), "id").first()["sharpness"] for k in grid]
    calls, real = [], V.elbow_sharpness
    monkeypatch.setattr(V, "elbow_sharpness", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = CL.search_parameters(df, "id", "v", "mix", grid)[0].collect()
    assert [r["min_samples"] for r in got] == list(grid) and [r["score"] for r in got] == pytest.approx(want)
    assert len(calls) == 1


@pytest.mark.parametrize("k", [3, 40])
def test_many_neighbours_equal_brute_force(spark, monkeypatch, k):
    """Lists by a bound from the nearest cells (k > 32) and by lists of them; ties by id, copies, several groups of queries."""
    monkeypatch.setattr(V, "MERGED", 500)
    rng = np.random.default_rng(2)
    v = np.round(2 * rng.normal(size=(300, 3)))
    v[250:] = np.round(30 + 2 * rng.normal(size=(50, 3)))
    for copies in (False, True):
        x = v if copies else v + 1e-3 * rng.random(v.shape)
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, v array<double>").repartition(3)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        got = {}
        for r in V.knn(df, "id", "v", k, cells=9, tile=32).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["neighbor"], r["distance"]))
        for i in range(300):
            order = sorted((y for y in range(300) if y != i), key=lambda y: (round(d[i, y], 9), y))[:k]
            assert [r[0] for r in got[i]] == order
            assert [r[1] for r in got[i]] == pytest.approx(d[i, order])
    far = V.knn(df, "id", "v", k, query=spark.createDataFrame([(7, [0.0, 0.5, 0.0]), (7, [0.0, 0.5, 0.0]), (8, None)], "id long, v array<double>"), cells=9, tile=32)
    assert far.count() == k and far.where("id = 8").isEmpty()


def test_a_row_per_query_leaves_a_block(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.normal(size=(200, 4)))], "id long, v array<double>")
    lists = V.knn_lists(df, "id", "v", 50)
    assert lists.count() == 200 and lists.selectExpr("min(size(list)) = 50 and max(size(list)) = 50").first()[0]
