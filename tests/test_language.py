"""Character n-gram language model."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from postlens.operators import language as L
from postlens.operators.classify import guess_language

WORDS = {"en": "the thing with that hat rather than other weather things".split(), "es": "los gatos que comen para nosotros ellos casas cuando".split(),
         "id": "yang dengan mahasiswa rakyat menolak undang bersama karena".split()}


def rows(n=240, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS[g], k=rnd.choice([1, 4, 12]))).title(), g) for i, g in enumerate(rnd.choices(list(WORDS), k=n))]


def slow(train, text):
    counts, sizes = {g: Counter() for g in WORDS}, Counter(g for *_, g in train)

    def grams(word):
        p = f"_{word}_"
        return [p[i:i + k] for k in (1, 2, 3) for i in range(len(p) - k + 1) if p[i:i + k] != "_"]
    for _, t, g in train:
        for w in t.lower().split():
            counts[g].update(grams(w))
    all_grams = set().union(*counts.values())
    score = {g: math.log(sizes[g] / len(train)) + sum(math.log((counts[g][x] + 1) / (sum(counts[g].values()) + len(all_grams)))
             for w in text.lower().split() for x in grams(w) if x in all_grams) for g in WORDS}
    return max(sorted(score), key=score.get)


def test_equals_plain_python(spark):
    train = rows()
    df = spark.createDataFrame(train, "id INT, t STRING, lang STRING")
    model = L.train_language_model(df, "t", "lang")
    asked = [(i, t) for i, t in enumerate(["gatos", "mahasiswa", "other", "ellos para", "xyz", "WEATHER", "dengan karena", "th"])]
    got = L.guess_language_ngrams(spark.createDataFrame(asked, "id INT, t STRING"), "t", model).collect()
    assert {r["id"]: r["guess"] for r in got} == {i: slow(train, t) for i, t in asked}


def test_odd_texts(spark):
    df = spark.createDataFrame(rows(), "id INT, t STRING, lang STRING")
    model = L.train_language_model(df, "t", "lang")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the " * 50_000)], "id INT, t STRING")
    assert {r["id"]: r["guess"] for r in L.guess_language_ngrams(odd, "t", model).collect()} == {1: "unknown", 2: "unknown", 3: "unknown", 4: "en"}
    none = L.train_language_model(df.limit(0), "t", "lang")
    assert {r["guess"] for r in L.guess_language_ngrams(odd, "t", none).collect()} == {"unknown"}


def test_held_out_and_short_texts(spark):
    """Held-out documents, whole and cut to three words: far above stop-word lists."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text rlike '[A-Za-z]{3}'")
    test = docs.where("doc_id % 5 = 0")
    model = L.train_language_model(docs.where("doc_id % 5 <> 0"), "text", "lang")
    short = test.withColumn("text", F.array_join(F.slice(F.split("text", r"\s+"), 2, 3), " "))
    right = lambda df: df.agg(F.avg(F.when(F.col("guess") == F.col("lang"), 1.0).otherwise(0.0))).first()[0]
    assert right(L.guess_language_ngrams(test, "text", model)) > 0.97
    ours, lists = right(L.guess_language_ngrams(short, "text", model)), right(guess_language(short, "text"))
    print("short texts", ours, lists)
    assert ours > 0.85 and ours > lists + 0.1
