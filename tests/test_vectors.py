"""kNN against brute force on planted blobs, connected components, density clusters, TwoNN."""

import math
import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import cluster as CL
from postlens.operators import vectors as V


@pytest.fixture(scope="module")
def blobs(spark):
    rnd = random.Random(7)
    rows = []
    centers = [(0.0, 0.0, 0.0), (10.0, 10.0, 0.0), (0.0, 10.0, 10.0)]
    i = 0
    for c in centers:
        for _ in range(60):
            rows.append((i, [x + rnd.gauss(0, 0.5) for x in c]))
            i += 1
    for _ in range(6):                                  # scattered noise
        rows.append((i, [rnd.uniform(-20, 30) for _ in range(3)]))
        i += 1
    return spark.createDataFrame(rows, "id LONG, v ARRAY<DOUBLE>"), rows


def _brute(rows, k):
    out = {}
    for i, a in rows:
        d = sorted((math.dist(a, b), j) for j, b in rows if j != i)[:k]
        out[i] = [j for _, j in d]
    return out


@pytest.mark.parametrize("cells,probe", [(1, 1), (6, 1), (12, 2)])
def test_knn_equals_brute_force(spark, blobs, cells, probe):
    df, rows = blobs
    nn = V.knn(df, "id", "v", 4, cells=cells, probe=probe, tile=16)
    got = {}
    for r in nn.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == _brute(rows, 4)


def test_knn_query_set(spark, blobs):
    df, rows = blobs
    q = spark.createDataFrame([(1000, [0.1, 0.1, 0.1])], "id LONG, v ARRAY<DOUBLE>")
    nn = V.knn(df, "id", "v", 3, query=q, cells=4).collect()
    want = sorted((math.dist([0.1] * 3, b), j) for j, b in rows)[:3]
    assert [r["neighbor"] for r in sorted(nn, key=lambda r: r["rank"])] == [j for _, j in want]


def test_candidates_stay_well_below_all_pairs(spark):
    rnd = random.Random(5)
    centers = [[rnd.uniform(-100, 100) for _ in range(4)] for _ in range(40)]
    rows = [(i, [x + rnd.gauss(0, 0.5) for x in centers[i % 40]]) for i in range(1200)]
    report = {}
    nn = V.knn(spark.createDataFrame(rows, "id LONG, v ARRAY<DOUBLE>"), "id", "v", 3, cells=40, report=report)
    got = {}
    for r in nn.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == _brute(rows, 3)
    print("compared", report)
    assert report["compared"] < 0.35 * 1200 * 1200


def test_equal_vectors_give_n_times_k_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000, [1.0, 3.0]), (1001, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id LONG, v ARRAY<DOUBLE>")
    nn = V.knn(df, "id", "v", 5)
    got = {}
    for r in nn.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == _brute(rows, 5)
    assert V.twonn_dimension(V.knn(df, "id", "v", 2), "id").count() == 1
    assert V.elbow_sharpness(V.kth_distance(nn, "id", 5), "id").first()["m1"] == 0.0
    out = CL.density_cluster(df, "id", "v", 5, 5, eps=0.0).collect()
    assert all((r["cluster"], r["probability"]) == ((0, 1.0) if r["id"] < 1000 else (-1, 0.0)) for r in out)


def test_equidistant_points_tie_by_id(spark):
    rows = [(i, [1.0 if i == j else 0.0 for j in range(40)]) for i in range(40)]
    nn = V.knn(spark.createDataFrame(rows, "id LONG, v ARRAY<DOUBLE>"), "id", "v", 3, cells=2)
    got = {}
    for r in nn.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == _brute(rows, 3)


def test_zero_vector_has_no_cosine(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "id LONG, v ARRAY<DOUBLE>")
    got = {r["id"]: r["similarity"] for r in V.centroid_similarity(df, "id", "v").collect()}
    assert got[1] is None and got[2] == pytest.approx(1.0)


def test_text_ids_and_modes(spark, blobs):
    df, rows = blobs
    text = df.selectExpr("concat('post-', id) AS id", "v")
    out = CL.density_cluster(text, "id", "v", min_samples=5, min_cluster_size=10, eps=1.5)
    assert {r["cluster"] for r in out.collect()} == {-1, 0, 1, 2}
    with pytest.raises(ValueError):
        CL.search_parameters(df, "id", "v", "other")
    a, b = (CL.search_parameters(df, "id", "v", m, [5, 10])[0].collect() for m in ("Mix", "mix"))
    assert a == b and a[0]["min_cluster_size"] == a[0]["min_samples"]


def test_validity_scores(spark, blobs):
    df, rows = blobs
    nn = V.knn(df, "id", "v", 4).checkpoint()
    three = df.selectExpr("id", "CASE WHEN id < 180 THEN CAST(id DIV 60 AS INT) ELSE -1 END AS cluster")
    mixed = df.selectExpr("id", "CASE WHEN id < 180 THEN CAST(id % 3 AS INT) ELSE -1 END AS cluster")
    for score in ("dbcv", "stability"):
        good, bad = (CL.validity(c, nn, "id", 5, score, df, "v").first()["validity"] for c in (three, mixed))
        assert good > 0.4 > 0.0 > bad >= -1.0
    one = df.selectExpr("id", "0 AS cluster")
    assert CL.validity(one, nn, "id", 5, "dbcv", df, "v").first()["validity"] == -1.0


def test_nearest_elsewhere(spark, blobs):
    df, rows = blobs
    x = df.selectExpr("id", "v", "CAST(id % 4 AS INT) AS g")
    got = {r["id"]: r["neighbor"] for r in V.nearest_elsewhere(x, "id", "v", "g", tile=32).collect()}
    assert got == {i: min((math.dist(a, b), j) for j, b in rows if j % 4 != i % 4)[1] for i, a in rows}


def test_density_clusters_find_blobs(spark, blobs):
    df, rows = blobs
    out = CL.density_cluster(df, "id", "v", min_samples=5, min_cluster_size=10, eps=1.5)
    by_blob = {}
    for r in out.collect():
        if r["id"] < 180:
            by_blob.setdefault(r["id"] // 60, set()).add(r["cluster"])
    assert all(len(s - {-1}) == 1 for s in by_blob.values())
    assert len({next(iter(s - {-1})) for s in by_blob.values()}) == 3
    assert out.where("cluster >= 0").agg(F.max("probability")).first()[0] == pytest.approx(1.0)


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v ARRAY<DOUBLE>")
    got = [r[0] for r in df.select(V.unit(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_twonn_on_a_plane(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.random(), rnd.random(), 0.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id LONG, v ARRAY<DOUBLE>")
    nn = V.knn(df, "id", "v", 2, cells=4)
    d = V.twonn_dimension(nn, "id", clip=(1, 50)).first()
    assert 1.5 < d["dimension"] < 2.6


def test_registered_searches_take_the_whole_range(monkeypatch):
    from postlens.plans import catalog, q_vectors
    asked = []
    monkeypatch.setattr(q_vectors, "_emb", lambda spark, sf_dir: None)
    monkeypatch.setattr(CL, "search_parameters", lambda df, i, v, mode, grid=None: asked.append((mode, grid)) or [None, 0, 0])
    for mode in ("search", "mix", "dbcv", "stability"):
        catalog.queries()[f"cluster_param_{mode}"](None, "")
    assert asked == [(m, None) for m in ("heuristic", "mix", "dbcv", "stability")]
    assert min(CL.PAIR_GRID) == min(CL.ELBOW_GRID) == 5 and max(CL.PAIR_GRID) == 500 and max(CL.ELBOW_GRID) == 100
