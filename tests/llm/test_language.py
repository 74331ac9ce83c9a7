"""Language identification (operator 13) against a slow model, and on held-out documents."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlens.llm import language_id as L
from postlens.llm import queries

DDL = "doc_id long, text string, lang string, score string"


def slow_counts(texts):
    """(order, gram) → count, all orders, no pruning."""
    found = Counter()
    for text in texts:
        data = b"\n" * L.ORDER + text.encode()
        for i in range(L.ORDER, len(data)):
            for k in range(L.ORDER + 1):
                found[k, data[i - k:i + 1]] += 1
    return found


def slow_length(counts, text):
    """Code length by walking from the longest context to the root."""
    after = defaultdict(dict)
    for (_, gram), n in counts.items():
        after[gram[:-1]][gram[-1]] = n
    data, units = b"\n" * L.ORDER + text.encode(), 0
    for i in range(L.ORDER, len(data)):
        for k in range(L.ORDER, -1, -1):
            node = after.get(data[i - k:i])
            if not node:
                continue
            n, d = sum(node.values()), len(node)
            if data[i] in node:
                units += round(math.log2((n + d) / node[data[i]]) * L.UNIT)
                break
            units += round(math.log2((n + d) / d) * L.UNIT)
        else:
            units += 8 * L.UNIT
    return units


TRAIN = {"aa": ["the cat and the hat", "that then this thing", "ünd"], "bb": ["el gato y la casa", "ella es la que", "niño"]}
TEXTS = ["the cat", "la casa", "", "xyz zzz", "ünd niño 日本", "a", "that " * 50]


def trees(least=1):
    rows = []
    for lang, texts in TRAIN.items():
        for (k, gram), n in slow_counts(texts).items():
            if k < 2 or n >= least:
                rows.append((lang, k, int.from_bytes(gram, "big"), n))
    return L.ContextTrees(sorted(TRAIN), np.zeros(2, np.int64), pd.DataFrame(rows, columns=["lang", "ord", "gram", "n"]))


@pytest.mark.parametrize("least", [1, 2])
@pytest.mark.parametrize("piece", [3, 7, 1 << 20])
def test_code_lengths_equal_the_slow_walk(monkeypatch, least, piece):
    monkeypatch.setattr(L, "PIECE_BYTES", piece)
    got = trees(least).code_lengths([t.encode() for t in TEXTS])
    for j, lang in enumerate(sorted(TRAIN)):
        counts = {g: n for g, n in slow_counts(TRAIN[lang]).items() if g[0] < 2 or n >= least}
        assert got[:, j].tolist() == [slow_length(counts, t) for t in TEXTS]


def test_gram_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000).astype(np.uint64))
    table = L.GramTable(keys)
    assert np.array_equal(table.find(keys), np.arange(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 40, 5000).astype(np.uint64), keys)
    assert (table.find(other) == -1).all()
    assert L.GramTable(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


def rows():
    rnd = random.Random(2)
    words = {"aa": "the cat and that hat of then thing with".split(), "bb": "el gato y la casa ella es que niño".split()}
    out = [(i, " ".join(rnd.choices(words[g], k=rnd.choice([2, 8, 30]))), g, "x") for i, g in enumerate(rnd.choices(["aa", "bb"], k=300))]
    return out + [(None, "the hat", None, "x"), (900, None, "aa", "x"), (901, "", "bb", "x"), (902, "123 ---", "aa", "x"), (903, "la casa " * 40_000, None, "x")] \
        + [(904, "the cat and the cat", "aa", "x")] * 150


def test_predicts_planted_languages(spark):
    df = spark.createDataFrame(rows(), DDL)
    got = L.identify(df.repartition(4), F.col("doc_id") % 4 == 2).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows()) and all(by[i]["lang_pred"] == g for i, t, g, _ in rows() if g and i < 900)
    assert [by[i]["lang_pred"] for i in (None, 900, 901, 902, 903)] == ["aa", "und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got) and by[900]["score"] == 0
    again = {r["doc_id"]: r for r in L.identify(df.repartition(2), F.col("doc_id") % 4 == 2).collect()}
    assert again == by


def test_trees_from_spark_counts(spark):
    df = spark.createDataFrame([(i, t, g, "x") for g, texts in TRAIN.items() for i, t in enumerate(texts)], DDL)
    got = L.fit_language_trees(df, F.lit(True)).code_lengths([t.encode() for t in TEXTS])
    assert np.array_equal(got, trees(2).code_lengths([t.encode() for t in TEXTS]))
    small = L.fit_language_trees(df, F.lit(True), model_cells=200)
    assert sum(len(c) for c in small.costs[2:]) < sum(len(c) for c in trees(2).costs[2:])


def test_empty(spark):
    none = spark.createDataFrame([], DDL)
    assert L.identify(none, F.lit(False)).count() == 0
    only = spark.createDataFrame([(1, "some words", "aa", "x")], DDL)
    assert [tuple(r) for r in L.identify(only, F.lit(True)).collect()] == [(1, "und", 0.0, 0.0)]


def test_held_out_documents(spark):
    got = queries.QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01").alias("p")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = got.join(docs, "doc_id").where("held_out and text rlike '\\\\p{L}'").agg(
        F.avg(F.when(F.col("lang") == F.col("lang_pred"), 1.0).otherwise(0.0)).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert seen["n"] > 200 and seen["right"] > 0.97
