"""Every pair of neighbouring words counts, however many there are: the commonest 300 000 were kept."""
import random

import pytest

SCHEMA = "id long, t string"


def test_a_rare_pair_beyond_300_000_decides(spark):
    from postlens.operators import classify as C
    common = spark.range(300_001).selectExpr("concat('x', id, 'q y', id, 'q') t")
    rare = spark.createDataFrame([("ab cd",)] + [("abc",)] * 5 + [("d",)] * 5, "t string")
    corpus = common.unionByName(common).unionByName(rare)
    pairs = C.pair_counts(corpus, "t")
    assert pairs.count() == 300_002
    got = C.segment_column(spark.createDataFrame([(1, "AbCd")], SCHEMA), "t", C.unigram_counts(corpus, "t"), pairs=pairs).collect()
    assert [r["segmented"] for r in got] == ["ab cd"]


@pytest.mark.parametrize("words", [0, 10_000])
def test_pairs_by_blocks_equal_shipped_pairs(spark, monkeypatch, words):
    """Pairs beyond the shipped number, with a dictionary that is shipped (words = 10 000) or not, and few texts."""
    from postlens.operators import classify as C
    rng = random.Random(11)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["ab" * 14]
    corpus = spark.createDataFrame([(" ".join(rng.choices(stems, k=30)),) for _ in range(60)] + [(None,)], "t string")
    texts = ["".join(rng.choices(stems, k=rng.randint(1, 6))).title() + " a" for _ in range(200)] + [None, "", "Ab", "Ab"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(7, texts[7])], SCHEMA).repartition(3)
    counts, pairs = C.unigram_counts(corpus, "t"), C.pair_counts(corpus, "t").where("first != 'ab'")
    monkeypatch.setattr(C, "FEW_ROWS", 0)
    want = sorted(map(tuple, C.segment_column(df, "t", counts, pairs=pairs).collect()), key=str)
    assert want != sorted(map(tuple, C.segment_column(df, "t", counts).collect()), key=str)
    with monkeypatch.context() as m:
        m.setattr(C, "FEW_ROWS", 1_000)
        assert sorted(map(tuple, C.segment_column(df, "t", counts, pairs=pairs).collect()), key=str) == want
    monkeypatch.setattr(C, "PAIR_CHARS", 50)
    monkeypatch.setattr(C, "BLOCK_ROWS", 50)
    held = counts.count()
    shipped, plain = [], C._as_pairs
    monkeypatch.setattr(C, "_as_pairs", lambda p: shipped.append(1) or plain(p))
    monkeypatch.setattr(C, "BROADCAST_WORDS", min(words, held))
    if words:
        assert pairs.count() > held                           # the words are shipped, the pairs are not
    for bits in (1 << 27, 256):                               # with most bits set the join sorts out
        monkeypatch.setattr(C, "FILTER_BITS", bits)
        assert sorted(map(tuple, C.segment_column(df, "t", counts, pairs=pairs).collect()), key=str) == want
    assert not shipped


def test_few_texts_bring_their_own_pairs_to_the_driver(spark, monkeypatch):
    """All pairs came to the driver, whatever the texts."""
    from postlens.operators import classify as C
    corpus = spark.range(5_000).selectExpr("concat('x', id, 'q y', id, 'q ab cd') t")
    sizes, plain = [], C._as_pairs

    def seen(pairs):
        found = plain(pairs)
        sizes.append(found)
        return found
    monkeypatch.setattr(C, "_as_pairs", seen)
    df = spark.createDataFrame([(1, "AbCd"), (2, "zz"), (3, None)], SCHEMA)
    got = C.segment_column(df, "t", C.unigram_counts(corpus, "t"), pairs=C.pair_counts(corpus, "t")).collect()
    assert sorted((r["id"], r["segmented"]) for r in got) == [(1, "ab cd"), (2, "zz"), (3, None)]
    assert sizes == [{("ab", "cd"): 5_000}]
