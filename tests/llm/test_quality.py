"""Quality rules (operator 5): counts against a slow count, estimation on planted votes, labels."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import quality

DDL = "doc_id long, text string, kept string, n_words string"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n")]
    dups = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab \n\t\xa0#|<é", max_size=120),
                 st.lists(st.sampled_from("abcdefghijk"), max_size=80).map(lambda w: " ".join(w * 2))))
def test_counts(text):
    assert quality.text_metrics(text)[:5] == slow(text)


def test_whole_frame(spark):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + "."
    rows = [(1, good), (2, None), (3, ""), (4, good), (4, good), (None, good), (5, "menu | " * 50), (6, "x " * 30000), (7, "Ab*** cd$$$ " * 3 + " ".join(f"w{i}%%%" for i in range(90)))]
    df = spark.createDataFrame([(d, t, "c", "c") for d, t in rows], DDL)
    got = quality.score_quality(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == \
        sorted((str(d), *slow(t)) for d, t in rows)
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert {r.doc_id for r in got if r.kept} == {1, 4, None}
    empty = spark.createDataFrame([], DDL)
    assert quality.score_quality(empty).collect() == [] and quality.keep_good(empty).collect() == []


def test_estimation_finds_accuracies():
    rng = np.random.default_rng(5)
    good, right = rng.random(40_000) < 0.8, [0.95, 0.9, 0.8, 0.7, 0.6]
    votes = np.where(rng.random((40_000, 5)) < right, good[:, None], ~good[:, None])
    silent = rng.random((40_000, 5)) < 0.3
    counts = {}
    patterns = ["".join("-" if s else "g" if v else "j" for v, s in zip(a, b)) for a, b in zip(votes, silent)]
    for p in patterns:
        counts[p] = counts.get(p, 0) + 1
    model = quality.VoteModel().fit(counts)
    assert np.abs(model.accuracy - right).max() < 0.02 and abs(model.good - 0.8) < 0.02
    found = dict(zip(counts, model.posterior(list(counts)) >= 0.5))
    assert np.mean([found[p] == g for p, g in zip(patterns, good)]) > 0.93


def test_agrees_with_labels(spark):
    d = "/root/testdata/sf0.1"
    q = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet")).where("not base_failed")
    rows = q.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality]) > 0.995


@pytest.mark.parametrize("n", [0, 1, 8, 9, 17])
def test_window_edges(n):
    words = ["a", "b", "c", "d", "e", "f", "g", "h"] * 3
    assert quality.text_metrics(" ".join(words[:n]))[4] == slow(" ".join(words[:n]))[4]
