"""Learned text embeddings (H1) and keyword ranking (H12) against a dense decomposition."""

import random
from collections import Counter

import numpy as np
import pytest

from postlens.operators import embeddings as EM


def texts(n=300, seed=4):
    rnd = random.Random(seed)
    topics = [["cat", "dog", "pet", "food", "vet"], ["law", "court", "judge", "vote", "bill"], ["rain", "sun", "wind", "storm", "cloud"]]
    out = [" ".join(rnd.choices(rnd.choice(topics) + ["the", "and"], k=rnd.choice([2, 6, 15]))).title() for _ in range(n)]
    return out + [None, "", "!!", "alone"]


def slow_vectors(rows, dim, contexts, window=5):
    toks = [(t or "").replace("!", "").lower().split() for t in rows]
    count = Counter(w for t in toks for w in t)
    words = sorted(count, key=lambda w: (-count[w], w))
    pair = np.zeros((len(words), contexts))
    at = {w: i for i, w in enumerate(words)}
    for t in toks:
        for i, a in enumerate(t):
            for j, b in enumerate(t):
                if i != j and abs(i - j) <= window and at[b] < contexts:
                    pair[at[a], at[b]] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.log(pair * pair.sum() / (pair.sum(1, keepdims=True) * pair.sum(0, keepdims=True)))
    m = np.where(np.isfinite(m), np.maximum(m, 0), 0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    share = np.array([count[w] for w in words]) / sum(count.values())
    return words, (u[:, :dim] * np.sqrt(s[:dim])) * (EM.SMOOTH / (EM.SMOOTH + share))[:, None]


def test_equals_dense_decomposition(spark):
    rows = texts()
    model = EM.learn_word_vectors(spark.createDataFrame([(t,) for t in rows], "t string").repartition(5), "t", dim=4, contexts=10)
    words, want = slow_vectors(rows, 4, 10)
    got = np.stack([model.vectors[model.index[w]] for w in words])
    assert sorted(words) == sorted(model.index) and got @ got.T == pytest.approx(want @ want.T, abs=1e-8)      # up to the directions' signs
    again = EM.learn_word_vectors(spark.createDataFrame([(t,) for t in rows[::-1]], "t string").repartition(2), "t", dim=4, contexts=10)
    assert again.index == model.index and again.vectors == pytest.approx(model.vectors, abs=1e-8)


def test_neighbours_share_their_topic(spark):
    model = EM.learn_word_vectors(spark.createDataFrame([(t,) for t in texts(600)], "t string"), "t", dim=6, contexts=17)
    unit = {w: model.vectors[i] / (np.linalg.norm(model.vectors[i]) or 1) for w, i in model.index.items()}
    assert unit["cat"] @ unit["dog"] > unit["cat"] @ unit["judge"] + 0.3 and unit["rain"] @ unit["storm"] > unit["rain"] @ unit["vote"] + 0.3


def test_ranks_every_candidate(spark):
    rows = texts() + ["law court judge vote bill"] * 400
    corpus = spark.createDataFrame([(t,) for t in rows], "t string")
    model = EM.learn_word_vectors(corpus, "t", dim=6, contexts=17)
    words = ["judge vote", "rain", "unheard of", None, "Court"]
    got = {r["k"]: r["similarity"] for r in EM.rank_keywords(spark.createDataFrame([(w,) for w in words], "k string"), "k", corpus, "t", model).collect()}
    centre = model.encode([t.lower() for t in rows if t is not None]).mean(0)
    for w in words:
        v = model.encode([w.lower() if w else None])[0]
        want = v @ centre / (np.linalg.norm(v) * np.linalg.norm(centre)) if v.any() else None
        assert got[w] == (pytest.approx(want) if want is not None else None)
    assert got["unheard of"] is None and got[None] is None and len(got) == 5


def test_any_encoder(spark):
    def lengths(batch):
        return np.array([[len(t or ""), 1.0] for t in batch])
    df = spark.createDataFrame([("abc",), (None,), ("",)], "t string")
    assert [r["e"] for r in EM.encode_with(df, "t", lengths, "e").collect()] == [[3.0, 1.0], [0.0, 1.0], [0.0, 1.0]]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "t string")
    model = EM.learn_word_vectors(none, "t")
    asked = spark.createDataFrame([("word",)], "k string")
    assert model.index == {} and EM.rank_keywords(asked, "k", none, "t", model).first()["similarity"] is None
