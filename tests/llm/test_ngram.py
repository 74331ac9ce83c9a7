"""N-gram Jaccard join (operator 10) against all pairs."""

import random
import re
from fractions import Fraction

import pytest

from postlens.llm import ngram_join as J

DDL = "doc_id long, text string, kept string, rep long, comp long"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=0):
    rng = random.Random(seed)
    rows, passage = [], words(rng, 40)
    for g in range(25):
        base = words(rng, rng.choice([3, 6, 30, 80, 200]))
        for k in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = "new" + str(rng.random())[2:6]
            rows.append((g * 10 + k, " ".join(w)))
    rows += [(1000 + i, " ".join(words(rng, 30) + passage + words(rng, 30))) for i in range(15)]
    hot = words(rng, 60)
    rows += [(2000 + i, " ".join(hot[:-3] + words(rng, 3))) for i in range(60)] + [(3000 + i, " ".join(hot).upper() + ".") for i in range(20)]
    rows += [(4000, None), (4001, ""), (4002, " .,! "), (4003, "two words"), (4004, "Two, words!"), (None, " ".join(hot))]
    rows += [(3001, " ".join(hot).upper() + "."), (4005, " ".join(words(rng, 60_000)))]
    return rows


def slow(rows):
    sets, docs = {}, {}
    for d, t in rows:
        w = tuple(re.findall(r"\w+", (t or "").lower()))
        if d is not None:
            docs[d] = w
    for d, w in docs.items():
        sets[d] = {w[i:i + 5] for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(docs)
    links, parent = dict.fromkeys(ids, 0), {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a] | sets[b])) >= Fraction(4, 5):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, links[d], find(d), find(d) == d) for d in ids)


@pytest.mark.parametrize("tile", [1_500, 12])
def test_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE_ROWS", tile)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "c", 1, 1) for d, t in rows], DDL).repartition(4)
    got = J.near_duplicates(df).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == slow(rows)
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 0, None, True)]
    if tile > 1000:
        kept = J.drop_near_duplicates(df)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert J.near_duplicates(df).collect() == [] and J.drop_near_duplicates(df).collect() == []


def test_prefixes_shorten_until_recall(spark):
    assert J.meet_probability(0.8, 7, J.TREES) >= J.FLOOR
    rows = [(d, t, "c", 1, 1) for d, t in corpus(3)]
    signed = spark.createDataFrame(rows, DDL).mapInArrow(J._signatures(5, 6, 7), "doc_id long, digest binary, n_shingles long, sig array<int>")
    classes = signed.where("digest is not null").dropDuplicates(["digest"]).withColumnRenamed("doc_id", "rep").checkpoint()
    lengths = [J.candidate_ties(classes, 0.8, 6, 7, 0.5, target)[1] for target in (0.5, 0.99, 0.99999)]
    assert lengths[0] > lengths[1] >= lengths[2]


def test_several_texts_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "c", 1, 1), (1, b, "c", 1, 1), (2, a + " x", "c", 1, 1), (3, b, "c", 1, 1)]
    got = J.near_duplicates(spark.createDataFrame(rows, DDL)).collect()
    assert len(got) == 4 and {r.class_id for r in got} == {1}


def test_texts_of_one_id_stay_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(7, a, "c", 1, 1), (7, b, "c", 1, 1), (7, b, "c", 1, 1), (3, b + " x", "c", 1, 1), (2, c, "c", 1, 1), (2, c, "c", 1, 1),
            (2, c + " x", "c", 1, 1), (4, c + " y", "c", 1, 1), (4, None, "c", 1, 1), (4, "", "c", 1, 1)]
    rows += [(9, " ".join(f"w{k}x{i}" for i in range(20)), "c", 1, 1) for k in range(50)]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    got = sorted(tuple(r) for r in J.near_duplicates(df).where("doc_id != 9").collect())
    assert got == [(2, 2, 2, False), (2, 2, 2, True), (3, 1, 3, True), (4, 0, 4, True), (4, 2, 2, False), (7, 0, 7, True), (7, 1, 3, False)]
    kept = [(r.doc_id, r.text) for r in J.drop_near_duplicates(df).collect()]
    assert (7, a) in kept and (7, b) not in kept and (3, b + " x") in kept
    assert sorted(d for d, _ in kept) == [2, 3, 4, 7] + [9] * 50
