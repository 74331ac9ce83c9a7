"""Hard negatives (operator 11) against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import hard_negatives as H

DDL = "vec_id long, embedding array<float>, label string, cls string, rank long"


def brute(rows, every=3, positives=5, negatives=5):
    ok, width = {}, max((len(v) for _, v, *_ in rows if v), default=0)
    for i, v, g, *_ in rows:
        if i is None or g is None or v is None or None in v or not np.isfinite(v).all():
            continue
        q = np.zeros(width, np.int64)
        q[:len(v)] = np.floor(256 * np.array(v, np.float32).astype(np.float64))
        ok[i, g, q.tobytes()] = q
    out = []
    for (i, g, k), q in ok.items():
        if i % every:
            continue
        scores = [(-int(q @ x), j, h != g) for (j, h, b), x in ok.items() if (j, h, b) != (i, g, k)]
        near = sorted(s for s in scores if not s[2])[:positives]
        for p, j, _ in near:
            fit = sorted(s for s in scores if s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p)[:negatives]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every=3, **options):
    df = spark.createDataFrame(rows, DDL)
    return sorted(tuple(r) for r in H.mine_hard_negatives(df, F.col("vec_id") % every == 0, **options).collect())


def data(n=400, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(8, dim))
    rows = []
    for i in range(n):
        m = int(rng.integers(8))
        v = (middles[m] + rng.normal(size=dim) * 0.2) * rng.choice([0.3, 1.0])
        rows.append((i, np.round(v, 1).astype(np.float32).tolist(), str(m % 3 if rng.random() < 0.8 else 3), "x", 0))
    copy = rows[5][1]
    rows += [(n + k, copy, "1" if k % 2 else "2", "x", 0) for k in range(120)]             # a third: one vector, two labels
    return rows


@pytest.mark.parametrize("sizes", [{}, {"cluster_anchors": 4, "group_clusters": 2, "slice_rows": 7, "tile": 50}])
def test_equals_brute_force(spark, sizes):
    rows = data()
    want = brute(rows)
    assert len(want) > 1000 and mined(spark, rows, **sizes) == want


def test_odd_rows(spark):
    one = [1.0, 0.0]
    rows = [(0, one, "a", "x", 0), (0, one, "a", "x", 0), (3, one, "a", "x", 0), (4, [0.9, 0.0], "b", "x", 0), (5, one, "b", "x", 0),
            (6, [0.0, 0.0], "a", "x", 0), (7, [], "b", "x", 0), (9, [-1.0, 0.0], "c", "x", 0), (None, one, "a", "x", 0), (10, one, None, "x", 0),
            (11, None, "a", "x", 0), (12, [1.0, None], "b", "x", 0), (13, [float("nan"), 0.0], "b", "x", 0), (14, [float("inf"), 0.0], "b", "x", 0),
            (15, [1.0], "c", "x", 0), (18, [-1.0, 0.0], "c", "x", 0), (4, [0.8, 0.5], "a", "x", 0), (21, [3000.0, 1e5], "a", "x", 0), (24, [2900.0, 1e5], "b", "x", 0)]
    assert mined(spark, rows) == brute(rows)


def test_large_whole_numbers(spark):
    """Scores above 2**53 stay exact."""
    rows = [(k, [4e5 + k / 256, 4e5], "ab"[k % 2], "x", 0) for k in range(20)]
    got = mined(spark, rows)
    assert max(r[4] for r in got) > 2 ** 53 and got == brute(rows)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], "a", "x", 0)], every=1) == []


def test_walk_stops_certified():
    """A tight cluster's members leave the list long before its end and miss nothing."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(4000, 8)) * 20, np.full((50, 8), 100) + rng.integers(0, 9, (50, 8))]).round()
    q = np.full((4, 8), 100.0) + rng.integers(0, 5, (4, 8))
    norm, unit = H._units(x)
    model = H.Clusters(H._units(q)[1].mean(0, keepdims=True) / np.linalg.norm(H._units(q)[1].mean(0)), 4)
    model.cos[:] = (H._units(q)[1] @ model.centres[0]).min() - 1e-9
    bound = model.bounds(unit, norm)[:, 0]
    assert (bound[None, :] * H._units(q)[0][:, None] >= q @ x.T - 1e-6).all()
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(self)[at]
    win, score, cand = H.walk_list(x.view(Watched), np.ones((4, len(x)), bool), bound, 1e-7 * norm.max(), q, H._units(q)[0],
                                   np.arange(4), np.full(4, -np.inf), np.full(4, np.inf), 5)
    assert sum(seen) < 5000
    for i in range(4):
        assert sorted(score[win == i].tolist(), reverse=True) == sorted((q[i] @ x.T).tolist(), reverse=True)[:5]
