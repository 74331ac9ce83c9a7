"""Samplers and splits: exact sizes, no duplicates, quotas, partition independence, hot groups."""

import pytest
from pyspark.sql import functions as F

from postlens.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    # cluster 0 holds a third of all rows (a hot group)
    data = [(i, 0 if i % 3 == 0 else (i % 7) + 1, (i % 100) / 100.0) for i in range(3000)]
    return spark.createDataFrame(data, "id LONG, cluster INT, p DOUBLE")


def test_exact_rank_matches_global_order(spark, rows):
    x = rows.withColumn("k", S.hash_key("id"))
    r = S.exact_rank(x, ["k", "id"], S.uniform_bucket(F.col("k"), 8)).select("id", "rank")
    got = {row["id"]: row["rank"] for row in r.collect()}
    want = {row["id"]: i + 1 for i, row in enumerate(x.orderBy("k", "id").collect())}
    assert got == want


def test_exact_rank_per_group(spark, rows):
    x = rows.withColumn("k", S.hash_key("id"))
    r = S.exact_rank(x, ["k", "id"], S.uniform_bucket(F.col("k")), by=["cluster"], with_size=True)
    agg = r.groupBy("cluster").agg(F.min("rank"), F.max("rank"), F.count("*"), F.first("group_size")).collect()
    for a in agg:
        assert a[1] == 1 and a[2] == a[3] == a[4]


def test_split_exact_sizes_and_disjoint(spark, rows):
    sp = S.split_exact(rows, "id", test=0.2)
    counts = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert counts == {"test": 600, "train": 2400}
    assert sp.select("id").distinct().count() == 3000


def test_split_counts_and_drop(spark, rows):
    sp = S.split_exact(rows, "id", test=100, train=200)
    counts = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert counts == {"test": 100, "train": 200}


def test_split_independent_of_partitioning(spark, rows):
    a = {r["id"] for r in S.split_exact(rows.repartition(1), "id", test=0.1).where("split='test'").collect()}
    b = {r["id"] for r in S.split_exact(rows.repartition(13), "id", test=0.1).where("split='test'").collect()}
    assert a == b


def test_balanced_sample_quotas(spark, rows):
    s = S.balanced_sample(rows, "id", "cluster", n=83)
    per = {r["cluster"]: r["count"] for r in s.groupBy("cluster").count().collect()}
    # 8 clusters: 83 // 8 = 10 each, the first 3 clusters (by id) one more
    assert per == {0: 11, 1: 11, 2: 11, 3: 10, 4: 10, 5: 10, 6: 10, 7: 10}
    assert s.select("id").distinct().count() == 83


def test_balanced_sample_clamped(spark):
    small = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id LONG, cluster INT")
    assert S.balanced_sample(small, "id", "cluster", n=50).count() == 3


@pytest.mark.parametrize("fm,bud,bias", [("above_mean_std", "direct_proportion", "uniform"),
                                          ("above_mean", "equal", "inverse_prob"),
                                          ("below_mean", "equal", "mild_inverse_prob"),
                                          ("none", "direct_proportion", "confidence_prob")])
def test_ablation_budgets(spark, rows, fm, bud, bias):
    s = S.ablation_sample(rows, "id", "cluster", "p", 120, filter_mode=fm, budget=bud, bias=bias)
    assert s.select("id").distinct().count() == s.count()
    per = s.groupBy("cluster").count().collect()
    assert all(r["count"] >= 1 for r in per)


def test_ablation_rejects_unknown(spark, rows):
    with pytest.raises(ValueError):
        S.ablation_sample(rows, "id", "cluster", "p", 10, budget="nope")


def test_dedup_first_keeps_smallest_id(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", "z")], "id INT, content STRING, other STRING")
    got = sorted((r["id"], r["other"]) for r in S.dedup_first(df, "content", "id").collect())
    assert got == [(1, "y"), (2, "z")]
