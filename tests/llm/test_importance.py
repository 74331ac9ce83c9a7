"""Importance resampling (operator 12) against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.llm import importance as I

DDL = "doc_id long, text string, rank string, weight string"


def grams(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, per_cent=5, min_words=20):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for text, into in [(d[1], s) for d in docs] + [(x, t) for x in target]:
        for b in grams(text)[1]:
            into[b] += 1
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * float(s.sum() + 10000)) / (float(s[b] + 1) * float(t.sum() + 10000)))) for b in range(10000)]
    rows = []
    for d, text, *_ in docs:
        n, f = grams(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:per_cent * len(able) // 100]):
        r[5] = k + 1
    return rows


def key(row):
    return tuple((x is None, x or 0) for x in row)


def check(spark, docs, target, per_cent=5, **options):
    got = [tuple(r) for r in I.resample(spark.createDataFrame(docs, DDL).repartition(5), spark.createDataFrame([(0, x) for x in target], "item_id long, text string"),
                                        per_cent=per_cent, **options).collect()]
    assert sorted(got, key=key) == sorted(map(tuple, brute(docs, target, per_cent)), key=key)
    return got


def corpus(n, seed=3):
    rnd = random.Random(seed)
    vocab = ["alpha", "Beta", "γάμμα", "d4", "straße", "x", "日本", "of", "the", "long" * 30] + [f"w{i}" for i in range(60)]
    docs = [(i * 2, rnd.choice([" ", "\n", "-", ", "]).join(rnd.choices(vocab, k=rnd.choice([0, 3, 19, 20, 40, 90]))), "x", "y") for i in range(n)]
    docs += [(1, None, "x", "y"), (3, "", "x", "y"), (None, docs[7][1], "x", "y"), (None, "the of " * 30, "x", "y")]
    docs += [(2 * n + i, "The of the of " * 10, "x", "y") for i in range(n // 2)] + [(5, "w1 w2 " * 20, "x", "y")] * 9
    return docs, [" ".join(rnd.choices(vocab[:12], k=50)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"samples": 20, "segments": 7}, {"per_cent": 60, "samples": 50, "segments": 5}, {"per_cent": 100}])
def test_equals_plain_python(spark, options):
    docs, target = corpus(300)
    got = check(spark, docs, target, **options)
    drawn = sorted(r[5] for r in got if r[5])
    assert drawn == list(range(1, len(drawn) + 1)) and drawn


def test_small_and_empty(spark):
    check(spark, [], ["a b c"])
    check(spark, [(1, "a b c", "", "")], [])
    check(spark, [(i, "word " * 25, "", "") for i in range(20)], ["word"])           # floor(5 * 20 / 100) = 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 .é日\n", max_size=60)), max_size=8), st.integers(1, 40))
def test_pieces_lose_no_run(texts, size):
    old, I.PIECE_BYTES = I.PIECE_BYTES, size
    try:
        found, at = [[] for _ in texts], 0
        for buckets, text, sizes, on in I.features([t.encode() if t is not None else None for t in texts]):
            at -= on
            for b, k in zip(buckets.tolist(), text.tolist()):
                found[at + k].append(b)
            at += len(sizes)
    finally:
        I.PIECE_BYTES = old
    assert [sorted(f) for f in found] == [sorted(grams(t)[1]) for t in texts]


def test_long_words_and_texts():
    word = "y" * 5000
    text = f"a {word} b {'z' * 64} {'z' * 63} {'z' * 62} c " * 40 + "tail " * 300_000
    found = np.concatenate([b for b, *_ in I.features([text.encode()])])
    assert np.array_equal(np.sort(found), np.sort(grams(text)[1]))


def test_sort_by_regular_sampling(spark):
    """Ranks of heavily tied keys, no segment much larger than its share."""
    rows = spark.range(20_000).select((F.col("id") % 7).alias("k1"), (F.col("id") * 37 % 1000).alias("k2"), F.col("id").alias("k3"))
    got = I.rank_first(rows.union(rows.selectExpr("null", "null", "k3")).repartition(9), 25, 500, 16).collect()
    best = sorted(tuple(r[:3]) for r in got if r["k1"] is not None)[:5000]
    assert [tuple(r[:3]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == best
    assert sum(r["rank"] is None for r in got) == 35_000
