"""Top n-grams (E3) against plain counting."""

import random
import re
from collections import Counter

import pytest

from postlens.operators import keywords as K


def slow(texts, n, n_max=5, least=1):
    counts = Counter()
    for t in texts:
        toks = re.findall(r"#\w+|\w{2,}", (t or "").lower())
        counts.update(" ".join(toks[i:i + k]) for k in range(1, n_max + 1) for i in range(len(toks) - k + 1))
    return sorted(((g, c) for g, c in counts.items() if c >= least), key=lambda x: (-x[1], x[0]))[:n]


def texts(seed=1, n=150):
    rnd = random.Random(seed)
    common, rare = ["aa", "bb", "cc", "#dd", "ee"], [f"w{i}" for i in range(400)]
    out = [" ".join(rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(rare) for _ in range(rnd.choice([0, 1, 6, 40]))) for _ in range(n)]
    return out + [None, "", "aa bb cc aa bb cc " * 200, "! ? -"]


@pytest.mark.parametrize("n,least", [(5, 1), (40, 1), (10_000, 1), (30, 4)])
def test_pruned_counts_equal_all_counts(spark, n, least):
    rows = texts()
    df = spark.createDataFrame([(t,) for t in rows], "content STRING")
    got = [tuple(r) for r in K.top_ngrams(df, n=n, stopwords=None, min_count=least).collect()]
    assert got == slow(rows, n, least=least)


def test_too_many_ties_count_everything(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_FREQUENT", 3)
    rows = texts(2, 40)
    df = spark.createDataFrame([(t,) for t in rows], "content STRING")
    assert [tuple(r) for r in K.top_ngrams(df, n=20, stopwords=None).collect()] == slow(rows, 20)
    assert K.top_ngrams(df.limit(0), n=20).collect() == []


def test_rare_tokens_do_not_reach_the_shuffle(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "content STRING")
    plan = K.top_ngrams(df, n=5, stopwords=None)._jdf.queryExecution().executedPlan().toString()
    assert "INSET" in plan or " IN (" in plan


def test_ngrams_are_formed_inside_runs_of_frequent_tokens(spark):
    """All n-grams of a text were formed and those with a rare token dropped."""
    df = spark.createDataFrame([(t,) for t in texts()], "content STRING")
    plan = K.top_ngrams(df, n=5, stopwords=None)._jdf.queryExecution().analyzed().toString()
    assert "explode(split(" in plan
