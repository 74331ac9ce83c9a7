"""Embedding near-duplicates (operator 9) against brute force."""

import numpy as np
import pytest

from postlens.llm import embedding_dedup as E

DDL = "vec_id long, embedding array<float>, label int, rep long, kept string"


def brute(rows, threshold=0.98):
    ok = []
    for i, v, g, *_ in rows:
        a = np.array([np.nan if x is None else x for x in v or []], np.float32).astype(np.float64)
        if i is not None and g is not None and a.size and np.isfinite(a).all() and (a != 0).any():
            ok.append((i, g, a))
    links, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, (i, g, a) in enumerate(ok):
        for j, h, b in ok[k + 1:]:
            if g == h and a.size == b.size and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in parent}


def data(n=700, hot=150, seed=3):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(3):
        middle = rng.normal(size=24)
        while len(rows) < (g + 1) * n // 3:
            base = middle * 0.5 + rng.normal(size=24)
            for _ in range(rng.integers(1, 4)):
                rows.append((i, (base + rng.normal(size=24) * rng.choice([0, 0.02, 0.1])).astype(np.float32).tolist(), g, 1, "x"))
                i += 1
    base = rng.normal(size=24)
    for _ in range(hot):
        rows.append((i, (base + rng.normal(size=24) * 0.05).astype(np.float32).tolist(), 1, 1, "x"))
        i += 1
    odd = [(None), [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] * 24, [1e-40] * 24, [1.0, 2.0], [2.0, 4.0], [3e38] * 24, [3e38] * 24]
    rows += [(i + k, v, 2, 1, "x") for k, v in enumerate(odd)]
    rows += [(i + 50, rows[0][1], None, 1, "x"), (i + 51, rows[0][1], 2, 1, "x")]
    return rows


def test_star_of_copies():
    """Copies around one vector: all but that one are pruned away from each other."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 64)), np.zeros((231, 64)) + rng.normal(size=64)])
    x[301:] += rng.normal(size=(230, 64)) * 0.09
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = E.FlatGraph(x).build().symmetric()
    there = (x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    found = np.zeros_like(there)
    for i in range(len(x)):
        found[i, graph.in_range(x[i], 0.98, skip=i, start=tuple(graph.neighbours[i]))] = True
    assert there.sum() > 10_000 and (found | found.T).sum() >= 0.99 * there.sum()


@pytest.mark.parametrize("shard,tile", [(60, 1200), (1000, 40)])
def test_equals_brute_force(spark, monkeypatch, shard, tile):
    monkeypatch.setattr(E, "TILE_ROWS", tile)
    rows, report = data(), {}
    got = E.near_duplicate_vectors(spark.createDataFrame(rows, DDL).repartition(4), shard_rows=shard, report=report).collect()
    links, root = brute(rows)
    assert len(got) == len(rows) and report["recall"] >= 0.99
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.99 * sum(links.values())
    wrong = [r for r in got if r.component_id != root[r.vec_id]]
    assert len(wrong) <= 0.01 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_rows_without_id_and_repeats(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v, 0, 1, "x"), (1, v, 0, 1, "x"), (2, v, 0, 1, "x"), (None, v, 0, 1, "x"), (3, w, 0, 1, "x")]
    got = E.near_duplicate_vectors(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (3, 0, 3, True)]))
    assert E.near_duplicate_vectors(spark.createDataFrame([], DDL)).collect() == []


def test_graph_finds_what_is_in_range():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 32))
    x[300:420] = x[5] + rng.normal(size=(120, 32)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = E.FlatGraph(x).build()
    assert max(map(len, graph.neighbours)) <= E.DEGREE * 1.5
    graph.symmetric()
    there = x @ x.T >= 0.98
    np.fill_diagonal(there, False)
    found = np.zeros_like(there)
    for i in range(900):
        found[i, graph.in_range(x[i], 0.98, skip=i, start=tuple(graph.neighbours[i]))] = True
    assert not (found & ~there).any()
    found |= found.T                                          # either end may find a pair
    assert found.sum() >= 0.995 * there.sum()


def test_one_id_on_several_vectors(spark):
    """Vectors of one id have nothing to do with each other unless they are alike."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    v2, w2 = [1.0, 0.01, 0.0], [0.01, 1.0, 0.0]

    def run(rows):
        return sorted(tuple(r) for r in E.near_duplicate_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], DDL)).collect())
    assert run([(1, v, 0), (1, w, 1), (2, v2, 0), (3, w2, 1)]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    assert run([(5, v, 0), (5, w, 0), (2, v2, 0), (3, w2, 0)]) == [(2, 1, 2, True), (3, 1, 3, True), (5, 1, 2, False), (5, 1, 3, False)]
    assert run([(-4, v, 0), (-4, v2, 0), (7, w, 0)]) == [(-4, 1, -4, True), (-4, 1, -4, True), (7, 0, 7, True)]
    assert run([(1, v, 0), (1, v, 1), (2, v, 1)]) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_planted_copies_are_evidence(spark):
    """Planted links are known on any table; what the search loses of them shows."""
    rng = np.random.default_rng(5)
    ddl = "rep long, first long, base long, copies long, label string, vector binary"
    classes = spark.createDataFrame([(i, i, i, 1, "0/24", bytearray(x.tobytes())) for i, x in enumerate(rng.normal(size=(400, 24)))], ddl)
    planted, there = E._planted(classes, 0.98)
    rows = planted.collect()
    assert len(rows) == len(there) == sum(n * k for n, k in E.PLANTED) and all(r["copies"] == 0 and r["rep"] < 0 <= r["base"] for r in rows)
    assert all(n >= 1 for n in there.values())
    got = spark.createDataFrame([(k, n if k % 2 else 0) for k, n in there.items()], "rep long, planted long")
    assert E._planted_recall(got, there) == pytest.approx(0.5, abs=0.01)
    assert E._planted(classes.limit(0), 0.98) == (None, {}) and E._planted_recall(got, {}) == 1.0


def test_planted_copies_leave_no_trace(spark):
    report = {}
    rows = [(i, v.tolist(), 0, 1, "x") for i, v in enumerate(np.random.default_rng(9).normal(size=(300, 24)))]
    got = E.near_duplicate_vectors(spark.createDataFrame(rows, DDL), shard_rows=50, report=report).collect()
    assert report["planted"] >= 0.99 and sorted(map(tuple, got)) == [(i, 0, i, True) for i in range(300)]


def test_leaders_by_blocks():
    x = np.random.default_rng(2).normal(size=(1500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = []
    for i in range(len(x)):
        if not kept or (x[kept] @ x[i]).max() < E.LEADER_COSINE:
            kept.append(i)
    assert np.array_equal(E.pick_leaders(x, 10_000), x[kept])
    assert np.array_equal(E.pick_leaders(x, 20), x[kept[:20]])


def test_goes_on_until_target(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(E, "_audit", lambda *a: asked.append(1) or 0.0)
    monkeypatch.setattr(E, "TILE_ROWS", 100)
    rows, report = data(400, 60), {}
    got = E.near_duplicate_vectors(spark.createDataFrame(rows, DDL).repartition(4), shard_rows=30, overlaps=(1, 2), report=report).collect()
    links, root = brute(rows)
    assert {r.vec_id: r.n_links for r in got} == links and all(r.component_id == root[r.vec_id] for r in got)
    assert len(asked) > 2 and report["overlap"] == 0
