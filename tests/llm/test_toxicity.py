"""Toxicity (operator 3): folding, matching against a slow matcher, learning, held-out accuracy."""

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import toxicity as T

DDL = "doc_id long, text string, score string, predicted string"


def test_fold():
    for spelled in ["1d10t", "idіоt", "IDIOT", "ｉｄｉｏｔ", "id­iot", "i d", "idi0t", "1DI0T!!"]:
        if spelled != "i d":
            assert "idiot" in T.fold(spelled), spelled
    assert T.fold("cl0wn c1own") == "ciown ciown"
    assert T.fold("in 2024, 3.5% or $100!! DE!!") == "in 2024, 3.5% or $100!! de!!"
    assert T.fold(None) == T.fold("") == ""


def slow_matches(model, text):
    folded = T.fold(text)
    spared = [(m.start(), m.end()) for e in model.exceptions for m in re.finditer(rf"(?<![^\W\d_])(?={re.escape(T.fold(e))}(?![^\W\d_]))", folded)]
    spared = [(a, a + len(T.fold(e))) for e in model.exceptions for a in range(len(folded)) if folded.startswith(T.fold(e), a)
              and not (a and folded[a - 1].isalpha()) and not folded[a + len(T.fold(e)): a + len(T.fold(e)) + 1].isalpha()]
    out = {}
    for kind, terms in (("stem", model.stems), ("word", model.words)):
        for term, w in terms.items():
            for a in range(len(folded)):
                b = a + len(term)
                if folded.startswith(term, a) and not (a and folded[a - 1].isalpha()) and (kind == "stem" or not folded[b:b + 1].isalpha()):
                    if a not in out or w > out[a][1]:
                        out[a] = (b, w)
    return [(a, w) for a, (b, w) in sorted(out.items()) if not any(x <= a < y for x, y in spared)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["trash", "trashy", "trash can", "can", "scum", "xscum", "scum.", "scums", "sc", " ", ".", "tr", "é"]), max_size=12).map("".join))
def test_matches(text):
    model = T.ToxicityModel({"scum": 2.0, "trashy": 5.0}, {"trash": 3.0, "tr": 1.0}, ("trash can",))
    assert [(a, w) for a, _, w in T.matches(model.automaton(), T.fold(text))] == slow_matches(model, text)


def test_learns_and_spares(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(3000):
        body = list(rng.choice(words, 40))
        toxic = i % 7 == 0
        if toxic:
            body[3], body[20] = "zorkian", "vilezor"
        elif i % 7 == 1:
            body[5:7] = ["zorkian", "lamp"]                      # an innocent phrase
        rows.append((i, " ".join(body), "x", "y"))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, "z0rki4n v1lezor", "x", "y"), (5001, None, "x", "y"), (5002, "", "x", "y"), (None, "no id", "x", "y"), (5003, "word " * 50_000, "x", "y")]
    rows += [(1, rows[1][1], "x", "y")]
    docs, lab = spark.createDataFrame(rows, DDL), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.fit_toxicity(docs, lab)
    assert "zorkian iamp" in model.exceptions
    got = T.score_documents(docs, lab).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == t for i, _, t in labels)
    assert by[5000].predicted == 1 and by[5001].score == by[5002].score < 0.5 and by[5003].predicted == 0
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - sum(t for _, _, t in labels) - 1


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(i, "foul text here" if i % 2 else "fair text here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, toxic int")
    model = T.fit_toxicity(docs, lab)
    assert not model.words and not model.stems
    empty = docs.limit(0)
    assert T.score_documents(empty, lab).collect() == []
    assert T.score_documents(docs, lab.limit(0)).where("predicted = 1").count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{d}/labels.parquet")
    got = T.score_documents(spark.read.parquet(f"{d}/documents.parquet"), lab).where("held_out").join(lab, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.98
