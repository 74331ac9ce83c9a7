"""Label repair and evaluation on small tables with ties, zero support and unlabelled rows."""

import pytest
from pyspark.sql import functions as F

from postlens.operators import evaluate as E
from postlens.operators import labels as L


def test_metrics_zero_division_and_macro_scope(spark):
    # class 2 never occurs in truth or prediction: per-class row is all zeros, macro ignores it
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label INT, pred INT")
    pc = {r["class"]: r for r in E.per_class_metrics(df, (0, 1, 2)).collect()}
    assert pc[2]["precision"] == 0.0 and pc[2]["support"] == 0
    assert pc[0]["precision"] == 1.0 and pc[0]["recall"] == 0.5
    s = E.summary_metrics(df, (0, 1, 2)).first()
    assert s["accuracy"] == 0.75
    assert s["macro_recall"] == pytest.approx((0.5 + 1.0) / 2)


def test_weighted_metrics_empty_when_no_support(spark):
    pc = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0)], "class INT, precision DOUBLE, recall DOUBLE, f1 DOUBLE, support LONG")
    assert E.weighted_metrics(pc).count() == 0


def test_confusion_zero_filled(spark):
    df = spark.createDataFrame([(0, 0)], "label INT, pred INT")
    rows = {r["label"]: (r["pred_0"], r["pred_1"]) for r in E.confusion_matrix(df, (0, 1)).collect()}
    assert rows == {0: (1, 0), 1: (0, 0)}


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label INT")
    bal = {r["class"]: r["weight"] for r in E.class_weights(df, "label", "balanced", (0, 1)).collect()}
    assert bal == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}
    binw = {r["class"]: r["weight"] for r in E.class_weights(df, "label", "binary").collect()}
    assert binw == {0: 0.25, 1: 0.75}


def test_mss_ties_and_minimum(spark):
    rows = [(0, 1, 1)] * 10 + [(0, 0, 1)] * 5 + [(1, 1, 1)] * 3 + [(1, 0, 0)] * 3
    df = spark.createDataFrame(rows, "cluster INT, label INT, pred INT")
    out = L.cluster_review(df).collect()
    assert len(out) == 1 and out[0]["cluster"] == 0          # cluster 1's minority < 5: skipped
    assert out[0]["misclassification_ratio"] == 1.0
    assert out[0]["mss_score"] == pytest.approx(5 ** 0.5)


def test_minority_flag_ignores_unlabelled(spark):
    df = spark.createDataFrame([(1, 0, -1), (2, 0, 2), (3, 0, 2), (4, 0, 1), (5, 1, -1)],
                               "id INT, cluster INT, sentiment INT")
    got = {r["id"]: (r["dominant_label"], r["needs_check"]) for r in L.minority_flag(df).collect()}
    assert got == {1: (2, False), 2: (2, False), 3: (2, False), 4: (2, True), 5: (None, False)}


def test_purity_and_propagation(spark):
    df = spark.createDataFrame([(1, 0, 1, "corrected"), (2, 0, 0, "uncorrected"), (3, 0, 1, "uncorrected"),
                                (4, 1, 0, "corrected"), (5, 1, 1, "corrected")],
                               "id INT, cluster INT, relevant INT, status STRING")
    p = {r["cluster"]: r for r in L.cluster_purity(df).collect()}
    assert p[0]["majority"] == 1 and p[0]["purity"] == 67 and p[0]["uncorrected"] == 2
    assert p[1]["majority"] == 1 and p[1]["complete"]              # tie → 1
    prop = {r["id"]: (r["relevant"], r["status"]) for r in L.majority_propagate(df).collect()}
    assert prop[2] == (1, "corrected") and prop[4] == (0, "corrected")


def test_upsert_updates_and_appends(spark):
    train = spark.createDataFrame([("1", "a", 0, True), ("2", "b", 1, True)],
                                  "tweet_id STRING, content STRING, sentiment INT, relevant BOOLEAN")
    corr = spark.createDataFrame([("1", 0, 2), ("3", -1, 0), ("4", 1, 1)],
                                 "tweet_id STRING, original_label INT, current_label INT")
    src = spark.createDataFrame([("3", "c", -1, False), ("4", "d", 1, False)],
                                "tweet_id STRING, content STRING, sentiment INT, relevant BOOLEAN")
    out = {r["tweet_id"]: (r["sentiment"], r["relevant"])
           for r in L.upsert_corrections(train, corr, src, "tweet_id", "sentiment").collect()}
    assert out == {"1": (2, True), "2": (1, True), "3": (0, True)}


def test_leakage_report(spark):
    tr = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "content STRING")
    te = spark.createDataFrame([("a",), ("c",), ("d",)], "content STRING")
    r = L.leakage_report(tr, te, "content").first()
    assert (r["overlap_count"], r["train_rows"], r["overlap_pct"]) == (2, 4, 50.0)


def test_review_queue_order(spark):
    df = spark.createDataFrame([(3, 0, "The x", 1, "corrected"), (1, 0, "the y", 0, "uncorrected"),
                                (2, 0, "nothing", 1, "uncorrected"), (4, 1, "the z", 1, "uncorrected")],
                               "id INT, cluster INT, content STRING, relevant INT, status STRING")
    got = [r["id"] for r in L.review_queue(df, 0, "THE").collect()]
    assert got == [1, 3]


def test_highlight_literal(spark):
    df = spark.createDataFrame([("a.b A.B axb",)], "c STRING")
    assert df.select(L.highlight(F.col("c"), "a.b")).first()[0] == "<mark>a.b</mark> <mark>A.B</mark> axb"


def test_nested_export_roundtrip(spark):
    df = spark.createDataFrame([(i, i % 2, 0.5, f"t{i}", "au", (i % 3) - 1) for i in range(10)],
                               "tweet_id INT, cluster INT, probability DOUBLE, content STRING, author STRING, sentiment INT")
    nested = L.review_export_nested(df, chunk=3)
    assert nested.groupBy("cluster_id").count().count() == 2
    flat = L.flatten_review(nested)
    assert sorted(int(r["tweet_id"]) for r in flat.collect()) == list(range(10))


def test_duplicate_corrections_keep_the_last(spark):
    from postlens.operators import labels as L
    rows = spark.createDataFrame([(1, 0), (2, 0)], "tweet_id long, label int")
    corr = spark.createDataFrame([("1", 5, 1), ("1", 6, 2), ("1", 4, 0)], "tweet_id string, label int, at int")
    got = L.apply_corrections(rows, corr, "tweet_id", "label", order_col="at").collect()
    assert sorted(map(tuple, got)) == [(1, 6), (2, 0)]
    preds = spark.createDataFrame([(1, 3, 1), (1, 2, 9)], "tweet_id long, pred int, at int")
    got = L.attach_predictions(rows, preds, "tweet_id", order_col="at").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2), (2, 0, -1)]
    train = spark.createDataFrame([("1", 0, True)], "tweet_id string, sentiment int, relevant boolean")
    source = spark.createDataFrame([("2", -1, False), ("2", -1, False)], "tweet_id string, sentiment int, relevant boolean")
    changes = spark.createDataFrame([("1", 0, 1, 1), ("1", 0, 2, 2), ("2", -1, 2, 1), ("2", -1, 1, 2)],
                                    "tweet_id string, original_label int, current_label int, at int")
    got = L.upsert_corrections(train, changes, source, "tweet_id", "sentiment", order_col="at").collect()
    assert sorted(map(tuple, got)) == [("1", 2, True), ("2", 1, True)]


def test_large_dictionary_is_joined(spark, monkeypatch):
    from postlens.operators import classify as C
    df = spark.createDataFrame([(1, "demomahasiswa jakarta"), (2, None), (3, ""), (4, "xyzzyq demo")], "id long, t string")
    words = spark.createDataFrame([("demo", 50), ("mahasiswa", 40), ("jakarta", 30)], "word string, cnt long")
    first = sorted(map(tuple, C.segment_column(df, "t", words).collect()))
    monkeypatch.setattr(C, "BROADCAST_WORDS", 0)
    assert sorted(map(tuple, C.segment_column(df, "t", words).collect()), key=str) == sorted(first, key=str)
    assert dict((r[0], r[2]) for r in first)[1] == "demo mahasiswa jakarta"


def test_self_training_takes_the_whole_sample(spark, monkeypatch):
    from postlens.operators import classify
    from postlens.plans import catalog
    asked = []
    monkeypatch.setattr(classify, "self_training_round", lambda posts, train, test, n, **options: asked.append(n))
    catalog.queries()["self_training"](spark, "/root/testdata/sf0.001")
    assert asked == [50_000]


def test_encode_labels_of_any_type(spark):
    from postlens.operators.search import encode_labels
    rows = [(i, float(x), x % 2 == 0, f"2024-01-{x % 28 + 1:02d}") for i, x in enumerate([5, -3, 7, 7, -200, 0, 41, 5])] + [(99, float("nan"), None, None), (98, float("inf"), None, None)]
    df = spark.createDataFrame(rows, "id int, x double, b boolean, d string").selectExpr("id", "x", "b", "cast(d as date) d", "id % 7 n")
    for col in ("x", "b", "d"):
        got = {r[0]: r[1] for r in encode_labels(df, col).select(col, f"{col}_id").collect() if r[0] is not None}
        values = [r[0] for r in df.select(col).where(f"{col} is not null").distinct().orderBy(col).collect()]
        assert len(got) >= len(values) - 1 and [got[v] for v in values if v == v] == list(range(len([v for v in values if v == v])))


def test_batches_of_a_column(spark):
    from postlens.sources.ingest import validate_posts
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "c"), (None, "d"), (None, None)], "k int, t string")
    valid, rejected = validate_posts(df, ["t"], "all", "k")
    assert sorted(r["t"] for r in valid.collect()) == ["b", "c"]
    assert sorted((str(r["k"]), r["reason"]) for r in rejected.collect()) == [("1", "batch rejected"), ("1", "missing or not a string: t"),
                                                                            ("None", "batch rejected"), ("None", "missing or not a string: t")]


def test_pairs_split_like_all_splits(spark):
    """Viterbi over (piece before, piece) against every split of short chunks."""
    import itertools
    import math
    from postlens.operators import classify as C
    corpus = ["demo maha siswa", "demo mahasiswa tolak", "maha siswa", "a b ab", "ab ab a", "tolak ruu", "ruu tni tolak ruu tni", "demoma hasiswa"]
    df = spark.createDataFrame([(t,) for t in corpus], "t string")
    counts, pairs = C.unigram_counts(df, "t"), C.pair_counts(df, "t")
    c, p = {r["word"]: r["cnt"] for r in counts.collect()}, {(r["first"], r["second"]): r["cnt"] for r in pairs.collect()}
    assert p[("ruu", "tni")] == 2 and p[("maha", "siswa")] == 2
    total = sum(c.values())

    def alone(w):
        return math.log10(c[w] / total) if w in c else math.log10(10 / total) - len(w)

    def score(split):
        s = alone(split[0])
        for a, b in zip(split, split[1:]):
            s += math.log10(p[(a, b)] / total) - alone(a) if (a, b) in p and a in c else alone(b)
        return s

    def best(chunk):
        cuts = [m for k in range(len(chunk)) for m in itertools.combinations(range(1, len(chunk)), k)]
        return max(score([chunk[i:j] for i, j in zip((0, *m), (*m, len(chunk)))]) for m in cuts)
    asked = ["demomahasiswa", "ruutnitolak", "abab", "aab", "xyztni", "tolakruutni", "q"]
    got = C.segment_column(spark.createDataFrame([(t.title(),) for t in asked] + [(None,), ("",), ("RUUTNI, abab!",)], "t string"), "t", counts, pairs=pairs).collect()
    for r in got[:len(asked)]:
        assert r["segmented"].replace(" ", "") == r["t"].lower() and math.isclose(score(r["segmented"].split(" ")), best(r["t"].lower()))
    assert [r["segmented"] for r in got[len(asked):-1]] == [None, ""] and got[-1]["segmented"].startswith("ruu tni ")
