"""Segmentation with a dictionary beyond the shipped words: blocks with their own words give the same splits."""
import random

import pytest


@pytest.mark.parametrize("by_pairs", [False, True])
def test_large_dictionary_by_blocks(spark, monkeypatch, by_pairs):
    from postlens.operators import classify as C
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    rows = [(i, " ".join(rng.choices(stems, k=rng.randint(0, 12))).replace(" ", "", rng.randint(0, 3)).title(), (i % 5, None)[i % 7 == 0])
            for i in range(300)] + [(300, None, 1), (300, None, 1), (301, "", 2), (301, "A b! " * 40, 2), (301, "A b! " * 40, 2)]
    df = spark.createDataFrame(rows, "id long, t string, other int").repartition(3)
    words = C.unigram_counts(spark.createDataFrame([(" ".join(rng.choices(stems, k=30)),) for _ in range(40)], "t string"), "t")
    pairs = C.pair_counts(df, "t") if by_pairs else None
    want = sorted(map(tuple, C.segment_column(df, "t", words, pairs=pairs).collect()), key=str)
    for shipped in (0, 20):
        monkeypatch.setattr(C, "BROADCAST_WORDS", shipped)
        monkeypatch.setattr(C, "BLOCK_ROWS", 7)
        monkeypatch.setattr(C, "FILTER_BITS", 256)            # most bits set: words that are none are sorted out by the join
        got = C.segment_column(df, "t", words, pairs=pairs)
        assert got.columns == ["id", "t", "other", "segmented"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_words_are_asked_once_per_block_and_texts_not_per_word(spark, monkeypatch):
    """The joined form carried the whole text with each of its words."""
    from postlens.operators import classify as C
    monkeypatch.setattr(C, "BROADCAST_WORDS", 0)
    text = " ".join(f"w{i % 50}" for i in range(2_000))
    df = spark.createDataFrame([(i, text) for i in range(4)], "id long, t string").coalesce(1)
    sizes = []
    plain = C._wanted

    def seen(held):
        run = plain(held)
        words = [b.num_rows for b in run(iter(df.selectExpr("0L as _block", "t").toArrow().to_batches()))]
        sizes.append(sum(words))
        return run
    monkeypatch.setattr(C, "_wanted", seen)
    assert C.segment_column(df, "t", C.unigram_counts(df, "t")).count() == 4
    assert sizes and sizes[0] <= 200


@pytest.mark.parametrize("by_pairs", [False, True])
def test_few_texts_ask_for_their_pieces_only(spark, monkeypatch, by_pairs):
    from postlens.operators import classify as C
    df = spark.createDataFrame([(1, "abcab Caéb"), (2, None), (2, ""), (3, "zzab" * 20), (3, "zzab" * 20)], "id long, t string")
    corpus = spark.createDataFrame([("ab ab c caéb zz zz x " + "w" * 30,), (None,)], "t string")
    words, pairs = C.unigram_counts(corpus, "t"), C.pair_counts(corpus, "t") if by_pairs else None
    with monkeypatch.context() as m:
        m.setattr(C, "FEW_ROWS", 0)
        want = sorted(map(tuple, C.segment_column(df, "t", words, pairs=pairs).collect()), key=str)
    monkeypatch.setattr(C, "_word_filter", None)              # no pass for a filter of the whole dictionary
    assert sorted(map(tuple, C.segment_column(df, "t", words, pairs=pairs).collect()), key=str) == want
    assert C._known_pieces(["abc"], words) == ({"ab": 2, "c": 1}, 8.0)
    assert C._known_pieces(["abc"], words.limit(0)) == ({}, 0.0)
