"""Byte-level BPE (operator 4) against tiktoken; unigram token counts (operator 8) against a
quadratic forward pass and the tokenizers library's unigram model."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm import byte_bpe, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
DDL = "doc_id long, text string, words string, ids string"
TEXTS = ["Hello, World! it's 2024.", "", None, " ", "   ", "a  b   c\n\n\nd \n e\t f  ", "a\x1c b\x1c\x1d  c", "x  y   z  w",
         "日本語 テキスト 👍🏽", "tab\t\ttab \t x", "the the the", "a" * 3000, "ab" * 199 + " " + "=-" * 300, "́ é ​ x",
         "word " * 2000, "we'll don't 'S '", "<|endoftext|>", "\r\n\r\nfoo \r\n bar", "ｆｕｌｌ Ⅳ ½ ٣"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def check(spark, library, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DDL)
    got = byte_bpe.encode_decode(df, RANKS, P.PATTERN, with_ids=True).collect()
    want = sorted((str(d), t or "", tuple(library.encode_ordinary(t or ""))) for d, t in rows)
    assert sorted((str(r.doc_id), bytes(r.decoded).decode(), tuple(r.ids)) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()


def test_equals_library(spark, library):
    check(spark, library, list(enumerate(TEXTS)) + [(None, "no id"), (3, "again"), (3, "again")])


def test_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WORDS_PER_ROW", 3)
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 7)
    monkeypatch.setattr(byte_bpe, "FLUSH_CHARS", 40)
    check(spark, library, list(enumerate(TEXTS)))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from(" \n\t\r\xa0ab'")), max_size=60), max_size=20))
def test_any_text(spark, library, texts):
    check(spark, library, list(enumerate(texts)) + [(1000, "end")])


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    assert byte_bpe.encode_decode(df, RANKS, P.PATTERN).collect() == []
    assert token_counts.count_tokens(df, PIECES).collect() == []


def test_heap_merges(library):
    ranks = byte_bpe.load_ranks(RANKS)
    for w in ["aaaaaaaaa", "mississippi", "=-" * 40, "abcabcabc" * 9]:
        assert byte_bpe.heap_merges(ranks, w.encode()) == library.encode_ordinary(w)


# ---- unigram counts

@pytest.fixture(scope="module")
def scores():
    return token_counts.load_scores(PIECES)


def slow_count(scores, text):
    """Quadratic forward pass over the whole text, no pre-tokens and no trie."""
    if not text:
        return 0
    word = ("▁" + text).replace(" ", "▁")
    unknown, longest = min(scores.values()) - token_counts.UNKNOWN_PENALTY, max(map(len, scores))
    f = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(f[k][0] + scores[word[k:end]], -f[k][1] - 1) for k in range(max(0, end - longest), end) if word[k:end] in scores]
        if word[end - 1] not in scores:
            options.append((f[end - 1][0] + unknown, -f[end - 1][1] - len(word[end - 1].encode())))
        s, n = max(options)
        f.append((s, -n))
    return f[-1][1]


def test_counts_equal_forward_pass(spark, scores):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (1, "▁ ▁▁x", "x", "y"), (1, "▁ ▁▁x", "x", "y")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, DDL), PIECES).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(d), slow_count(scores, t)) for d, t, _, _ in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from(" \naeioutrnsl▁")), max_size=80), max_size=8))
def test_small_trie_counts_alike(scores, texts):
    trie = token_counts.UnigramTrie(scores, max_nodes=20)
    for t in texts:
        assert trie.text(t)[0] == slow_count(scores, t)


def test_library_unigram(scores):
    from tokenizers import Tokenizer, models
    vocab = [("<unk>", 0.0)] + list(scores.items())
    model = Tokenizer(models.Unigram(vocab, unk_id=0))
    trie = token_counts.UnigramTrie(scores)
    text = open(P.path("README.md")).read().replace("\n", " ")
    words = sorted(w for w in set(text.split()) if set(w) <= set(scores) and "<unk>" not in w)
    ours = sum(trie[" " + w] for w in words)
    theirs = sum(len(model.encode("▁" + w).ids) for w in words)
    assert ours == theirs


def test_near_the_library_count(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(rows, PIECES).collect()}
    want = {r.doc_id: len(sp.encode(r.text or "")) for r in rows.collect()}
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.03
