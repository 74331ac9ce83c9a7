"""Certification by blocks of cells: equal to brute force whatever the blocks, and no vector per visited cell."""
import numpy as np
import pytest


def _points(spark, n, kind="long"):
    rng = np.random.default_rng(3)
    v = np.round(3 * rng.normal(size=(n, 6)))   # whole numbers: ties are exact
    v[::9] = v[0]                                             # copies
    ids = [f"p{i:04d}" if kind == "string" else i for i in range(n)]
    return ids, v, spark.createDataFrame([(i, x.tolist(), int(j % 4)) for j, (i, x) in enumerate(zip(ids, v))], f"id {kind}, v array<double>, g int").repartition(3)


@pytest.mark.parametrize("kind,limit,ks", [("long", 32_768, (7,)), ("string", 5, (60,))])
def test_blocks_equal_brute_force(spark, monkeypatch, kind, limit, ks):
    from postlens.operators import vectors as V
    monkeypatch.setattr(V, "BLOCK_POINTS", limit)
    ids, v, df = _points(spark, 260, kind)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for k in ks:
        got = {(r["id"], r["rank"]): (r["neighbor"], r["distance"]) for r in V.knn(df, "id", "v", k, cells=12, tile=16).collect()}
        assert len(got) == 260 * k
        for i in range(0, 260, 5):
            order = sorted((x for x in range(260) if x != i), key=lambda x: (round(d[i, x], 9), x))[:k]
            assert [got[ids[i], r + 1][0] for r in range(k)] == [ids[x] for x in order]
    far = {r["id"]: (r["neighbor"], r["distance"]) for r in V.nearest_elsewhere(df, "id", "v", "g", tile=16).collect()}
    for i in range(260):
        x = min((x for x in range(260) if x % 4 != i % 4), key=lambda x: (round(d[i, x], 9), x))
        assert far[ids[i]][0] == ids[x] and abs(far[ids[i]][1] - d[i, x]) < 1e-9


def test_a_vector_travels_per_block_and_few_points_come_back(spark):
    from postlens.operators import vectors as V
    _, v, df = _points(spark, 400)
    ref = df.selectExpr("id _rid", "v _rv")
    placed, centers, radii = V._cells(ref, 16, 42)
    layout, size = V._blocks(placed, centers, radii, 100)
    assert len(layout[4]) < 16 and sorted(np.concatenate(layout[4]).tolist()) == list(range(16))
    held = spark.sparkContext.broadcast(layout)
    q = df.selectExpr("id _qid", "v _qv", "1e9D _bound").toPandas()
    rows = sum(len(x) for x in V._block_visits(held, 2)(iter([q])))
    assert rows <= 400 * len(layout[4])                       # 400 * 14 by cells
    near = V._block_search(df.selectExpr("id _qid", "v _qv", "3.0D _bound"), placed, centers, radii, 0, 9, 100, ("_qid", "_rid"))
    assert near.where("distance > 3.0001").count() == 0


def test_blocks_are_bounded_by_bytes(spark):
    """Blocks of 32 768 points whatever their size made 31 blocks of a million short vectors."""
    from postlens.operators import vectors as V
    placed = spark.range(1_000_000).selectExpr("id _rid", "cast(id % 40 as int) _cell")
    for dim in (64, 1024):
        centers = np.random.default_rng(1).normal(size=(40, dim))
        layout, size = V._blocks(placed, centers, np.ones(40), 2048)
        assert size * dim * 8 <= V.BLOCK_BYTES and size <= V.BLOCK_POINTS
        if dim == 64:
            assert len(layout[4]) <= 14
