"""Token-id files (operator 1) and packing (operator 6) against the tokenizers library itself."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postlens.llm import common, dac, packing
from postlens.llm.token_bytes import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World! it's 2024.", "", None, "ÄÖÜ straße été ́x", "a b c\td\r\ne\x1cf", "x" * 5000,
         "Hello, World! it's 2024.", "日本語 テキスト 👍🏽", "İstanbul ΑΣ ΑΣ. Σ", "<|endoftext|> <|startoftext|>x", "hello <|endoftext|> x", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|><|endoftext|>. é<|endoftext|>́", "a  b   c\n\n\nd",
         " ".join(["word. more"] * 4000)]
DDL = "doc_id long, text string, n_tokens string"


def rows():
    return [(i * 3, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (6, "again", "x"), (6, "again", "x")]


#: The file as it is, apart from the operators' own encoder.
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def expected():
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, at = [], 0
    for d, t, _ in order:
        ids = library_ids(t)
        out.append((d, at, ids))
        at += len(ids)
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from(" \n\t.,!'aAéÉſ"))))
def test_word_cache_equals_library(text):
    assert np.frombuffer(encoder(PATH).text(text), "<u4").tolist() == library_ids(text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 300), st.sampled_from([255, 256, 65535, 65536])), max_size=1500))
def test_levels_give_random_access(ids):
    out = io.BytesIO()
    dac.write_file(out, [7, None], [len(ids) // 2, len(ids) - len(ids) // 2], np.array(ids, "<u4"))
    reader = dac.DacReader(out)
    assert reader.slice(0, len(ids)).tolist() == ids and reader.doc_ids == [7, None]
    for i in range(0, len(ids), 37):
        assert reader.get(i) == ids[i]
        assert reader.slice(i, min(len(ids), i + 11)).tolist() == ids[i:i + 11]
    assert reader.document(1).tolist() == ids[len(ids) // 2:]


def test_files_in_order(spark):
    df = spark.createDataFrame(rows(), DDL).repartition(3)
    out = common.run_dir(spark, "t1")
    got = dac.read_ids(dac.write_ids(df, out, PATH, file_tokens=2000), out, with_ids=True).collect()
    want = expected()
    assert sorted((r.start, r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == \
        sorted((s, d if d is not None else -1, ids) for d, s, ids in want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], DDL)
    out = common.run_dir(spark, "t1")
    assert dac.read_ids(dac.write_ids(df, out, PATH), out).collect() == []
    assert packing.pack(df, PATH).collect() == []


def padding(length, size):
    return 0 if length & (length - 1) == 0 else size - length


def check_packing(pieces, docs, size):
    """Each id in exactly one piece, sequences gapless and within size."""
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
    got = sorted((-1 if p.doc_id is None else p.doc_id, p.start, p.length, p.doc_tokens) for p in pieces)
    assert sum(p.length for p in pieces) == sum(len(ids) for _, _, ids in docs)
    return got, sum(padding(sum(p.length for p in ps), size) for ps in by_seq.values())


def test_packing_whole(spark):
    df = spark.createDataFrame(rows(), DDL).repartition(3)
    got = packing.pack(df, PATH, run_tokens=9000, with_ids=True).collect()
    check_packing(got, expected(), 4096)
    texts = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        texts.setdefault(p.doc_id, []).extend(p.ids)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    want = {}
    for d, _, ids in expected():
        want.setdefault(d, []).extend(ids)
    assert texts == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.booleans()), min_size=1, max_size=25))
def test_queue_equals_quadratic(docs):
    size = 16
    doc_ends = np.cumsum([n for n, _ in docs])
    sentences = np.array([e - n // 2 for e, (n, s) in zip(doc_ends, docs) if s and n > 2], np.int64)
    pos, kinds = packing.candidates(doc_ends, sentences, size, 4)
    price = [packing.PRICES[k] for k in kinds]
    f = [0] + [None] * (len(pos) - 1)
    for j in range(1, len(pos)):
        f[j] = price[j] + min(f[i] + padding(int(pos[j] - pos[i]), size) for i in range(j) if pos[j] - pos[i] <= size)
    cuts = packing.best_cuts(pos, kinds, size)
    at = {int(p): k for p, k in zip(pos, price)}
    assert sum(padding(b - a, size) + at[b] for a, b in zip(cuts, cuts[1:])) == f[-1]
    assert all(0 < b - a <= size for a, b in zip(cuts, cuts[1:]))


def test_padding_is_small(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(df, PATH, n_shards=4)
    per = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    total = sum(r[1] for r in per)
    assert sum(padding(r[1], 4096) for r in per) < 0.01 * total


def test_size_must_be_power(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], DDL), PATH, size=100)
