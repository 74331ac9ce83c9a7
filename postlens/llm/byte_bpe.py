"""Operator 4: byte-level BPE encoding and decoding.

Per block of documents the distinct words (matches of the split pattern) go once through a Spark
expression: each word's byte array is folded by ``aggregate``, every step merging the neighbours of
least rank, with the rank map held as literal arrays.  The same projection decodes each word's ids:
the pieces of the ids are laid end to end.  (Spark joins arrays of strings only, so pieces are held as
hexadecimal digits and the joined digits are turned back into bytes.)  Documents are then put together
from their words' results.

One narrow stage, no shuffle: split (Python) → fold and decode (JVM) → assemble (Python).  Words are
distinct per block of at most about ``BLOCK_WORDS`` words, not per corpus: a corpus-wide word table would
have to be joined back to every occurrence, which shuffles more than the texts themselves.  Documents
leave the splitting side every ``FLUSH_CHARS`` characters, after those words that are new since the last
time; the assembling side holds a block's words as flat buffers with offsets and gathers from them.  All
buffers are bounded and lose nothing.

Words that many blocks share are folded once: a table of at most ``SHARED_WORDS`` words of at most
``SHARED_BYTES`` bytes, the commonest of a bounded sample of the texts, goes through the same
expression first and is broadcast (at most about 15 MB).  It saves time only; a word that is not in
it is folded in its block.

The rank map: neighbours are looked up by their ids in a table compressed by row displacement (two
literal arrays), because a Spark map is searched linearly.  In rank files the rank of a merge is the
id of the merged piece.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.session import checkpoint_dir

#: Words of a block's own, and characters of documents held until they go on.
BLOCK_WORDS, FLUSH_CHARS = 220_000, 4_000_000
#: The shared table, and the characters of text that it is chosen from.
SHARED_WORDS, SHARED_BYTES, SHARED_SAMPLE = 220_000, 32, 60_000_000
#: Chunks of text (with their bytes, at most) whose words a task remembers.
CHUNKS, CHUNK_BYTES = 200_000, 12_000_000
#: Words of a document put together at once.
GATHER_WORDS = 1 << 16
#: Words of a block travel in rows of this many.
WORDS_PER_ROW = 1024
#: Array copies make a fold quadratic in the word's length; longer words use a heap (same merges).
FOLD_BYTES = 400
NO_PAIR = 2**17 - 1

#: Boundaries that are always token boundaries: the start of a run of spaces and line feeds.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space joins such a run, so texts with it are split as one chunk.
_OTHER_SPACE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """left * 65536 + right → merged id, for every pair of pieces whose join is a piece."""
    return {ranks[p[:k]] << 16 | ranks[p[k:]]: r for p, r in ranks.items() for k in range(1, len(p))
            if p[:k] in ranks and p[k:] in ranks}


def comb_table(pairs: dict[int, int], ids: int) -> dict[str, list[int]]:
    """Row displacement: the row of a left id is laid over the others at ``base[left]``, so the pair
    (left, right) can only stand in slot ``base[left] + right``; the slot holds ``left << 17 | merged``.
    Ids run to ``ids``, which stands for the edge of a word and has no pairs."""
    rows: dict[int, list[int]] = {}
    for key in pairs:
        rows.setdefault(key >> 16, []).append(key & 65535)
    room = 2 * len(pairs) + 2 * ids + 70_000
    comb, base, window, free = np.full(room, -1, np.int64), [0] * (ids + 1), 4096, 0
    for left, rights in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        cols = np.array(sorted(rights))
        at = 0 if len(cols) > 8 else max(0, free - int(cols[0]))
        while True:
            taken = np.zeros(window, bool)
            for c in cols.tolist():
                taken |= comb[at + c: at + c + window] >= 0
            if not taken.all():
                break
            at += window
        base[left] = at = at + int(np.argmin(taken))
        comb[at + cols] = [left << 17 | pairs[left << 16 | c] for c in cols.tolist()]
        while comb[free] >= 0:
            free += 1
    return {"base": base, "comb": comb[:max(base) + ids + 1].tolist()}


@lru_cache(maxsize=4)
def _tables_json(path: str) -> str:
    ranks = load_ranks(path)
    ids = max(ranks.values()) + 1
    if ids >= 65535:
        raise ValueError("ids must be below 65535")
    return json.dumps(comb_table(merge_pairs(ranks), ids) | {
        "edge": ids, "bytes": [ranks[bytes([b])] for b in range(256)]}, separators=(",", ":"))


def rank_tables(path: str) -> Column:
    """The literal: a constant that the optimizer folds to arrays once per plan."""
    return F.from_json(F.lit(_tables_json(path)),
                       "edge int, base array<int>, comb array<bigint>, bytes array<int>")


def let(value: Column, body) -> Column:
    """``body(x)`` with x evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pair_rank(t: Column, left: Column, right: Column) -> Column:
    """Merged id of two neighbours, or ``NO_PAIR``."""
    slot = F.get(t["comb"], (F.get(t["base"], left.cast("int")) + right).cast("int"))
    return F.when(F.shiftright(slot, 17) == left, slot.bitwiseAND(F.lit(NO_PAIR))).otherwise(F.lit(NO_PAIR).cast("bigint"))


def fold_merges(t: Column, word: Column) -> Column:
    """Byte values of a word (``array<int>``, at most ``FOLD_BYTES``) → its token ids.

    One number per piece: rank with the next piece (from bit 25) | place of its first byte (9 bits)
    | id (16 bits), with an edge piece at both ends.  The least number is the merge of least rank,
    leftmost on ties."""
    low16, low25 = F.lit(65535), F.lit((1 << 25) - 1)
    ids = F.concat(F.array(t["edge"]), F.transform(word, lambda b: F.get(t["bytes"], b)), F.array(t["edge"]))
    start = let(ids, lambda p: F.transform(p, lambda x, i: F.shiftleft(pair_rank(t, x, F.coalesce(F.get(p, i + 1), t["edge"])), 25)
                                           + F.shiftleft(i, 16) + x))

    def merge(q: Column, least: Column, i: Column) -> Column:
        """Element i (from 0) and the next one become one piece; the one before gets a new rank."""
        def at(x: Column, k: Column) -> Column:
            new = F.shiftright(least, 25)
            return (F.when(x == least, F.shiftleft(pair_rank(t, new, F.get(q, i + 2).bitwiseAND(low16)), 25)
                           + least.bitwiseAND(F.lit(511 << 16)) + new)
                    .when(k == i - 1, F.shiftleft(pair_rank(t, x.bitwiseAND(low16), new), 25) + x.bitwiseAND(low25))
                    .otherwise(x))
        return F.array_remove(F.transform(q, at), F.get(q, i + 1))

    def step(q: Column, _: Column) -> Column:
        return let(F.array_min(q), lambda least: F.when(least >= F.lit(NO_PAIR << 25), q).otherwise(
            let(F.array_position(q, least).cast("int") - 1, lambda i: merge(q, least, i))))

    return F.aggregate(F.slice(word, 2, F.size(word)), start, step, lambda q: F.transform(
        F.slice(q, F.lit(2), F.size(q) - 2), lambda x: x.bitwiseAND(low16).cast("int")))


@lru_cache(maxsize=4)
def _pieces_json(path: str) -> str:
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        pieces[r] = p.hex()
    return json.dumps({"pieces": pieces}, separators=(",", ":"))


def encode_words(path: str, words: Column, known: Column) -> Column:
    """``array<array<int>>`` of byte values → ids of each word; ``known`` holds ready ids or null."""
    both = lambda t: F.zip_with(words, known, lambda w, k: F.coalesce(k, fold_merges(t, w)))
    return let(rank_tables(path), both)


def decode_words(path: str, ids: Column) -> Column:
    """``array<array<int>>`` of token ids → the bytes of each word: its pieces laid end to end."""
    table = F.from_json(F.lit(_pieces_json(path)), "pieces array<string>")
    return let(table, lambda t: F.transform(ids, lambda word: F.unhex(
        F.array_join(F.transform(word, lambda i: F.get(t["pieces"], i)), ""))))


def encoded_and_decoded(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` and ``decoded`` to rows of words; the ids are computed once."""
    coded = let(encode_words(path, F.col("bytes"), F.col("known")), lambda ids: F.struct(ids.alias("ids"), decode_words(path, ids).alias("decoded")))
    return rows.withColumn("coded", F.when(F.col("bytes").isNotNull(), coded)).select("doc_id", "words", "coded.ids", "coded.decoded")


def heap_merges(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same merges — least rank first, leftmost on ties — for a long word."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    piece = [word[i:i + 1] for i in range(n)]
    heap = [(ranks[word[i:i + 2]], i, word[i:i + 2]) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if piece[i] else n
        if j >= n or piece[i] + piece[j] != joined:
            continue
        piece[i], piece[j], after[i] = joined, b"", after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (pair := piece[a] + piece[b]) in ranks:
                heapq.heappush(heap, (ranks[pair], a, pair))
    return [ranks[p] for p in piece if p]


_ROWS = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("bytes", pa.list_(pa.list_(pa.int32()))),
                   ("known", pa.list_(pa.list_(pa.int32())))])
_ROWS_DDL = "doc_id long, words binary, bytes array<array<int>>, known array<array<int>>"


#: Marks that are a word of their own after letters.
MARKS = frozenset(".,;:")


def _finder(pattern: str):
    import regex
    return regex.compile(pattern).findall


def chunks_of(text: str | None) -> list[str]:
    """Pieces of a text that no word crosses, in order."""
    if not text:
        return []
    return [text] if _OTHER_SPACE.search(text) else _CHUNK.findall(text)


def cut_at_spaces(text: str) -> list[str] | None:
    """``text.split(" ")`` where every cut is a word boundary, the space going with what follows; else
    None.  A cut inside a run of white space is none."""
    if "  " in text or "\n \n" in text or text.endswith("\n ") or _OTHER_SPACE.search(text):
        return None
    return text.split(" ")


#: Marks the first words of a block.
_FRESH = b"block"


def _word_rows(found: list[bytes], ranks: dict[bytes, int], fresh: bool = False) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(found), WORDS_PER_ROW):
        some = found[k:k + WORDS_PER_ROW]
        known = [[ranks[w]] if w in ranks else heap_merges(ranks, w) if len(w) > FOLD_BYTES else None for w in some]
        plain = [w if i is None else b"" for w, i in zip(some, known)]
        values = pa.array(np.frombuffer(b"".join(plain), np.uint8).astype(np.int32))
        ends = np.concatenate([[0], np.cumsum([len(w) for w in plain])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array([None], pa.int64()), pa.array([_FRESH if fresh and not k else None], pa.binary()),
            pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), values)),
            pa.array([known], _ROWS.field("known").type)], schema=_ROWS)


def _in_slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple]:
    """Rows of a batch; only some texts at a time become Python strings."""
    for k in range(0, batch.num_rows, rows):
        yield from common.rows_of(batch.slice(k, rows), "doc_id", "text")


def _split(path: str, pattern: str, shared):
    """Documents → per block, first rows of its own distinct words, then its documents as word
    numbers: those of the shared table first, the block's after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ranks = _finder(pattern), load_ranks(path)
        index = _once("index", shared, SharedTable.index)
        own: dict[str, int] = {}
        n, held, sent = len(index), 0, 0

        class Chunks(dict):
            """chunk (after ``lead``) → its words' numbers"""

            def __init__(self, lead: str):
                super().__init__()
                self.lead = lead

            def __missing__(self, chunk: str) -> bytes:
                if chunk.isalpha():
                    found = number(self.lead + chunk)
                elif chunk[-1:] in MARKS and chunk[:-1].isalpha():
                    found = number(self.lead + chunk[:-1]) + number(chunk[-1])
                else:
                    found = b"".join(map(number, find(self.lead + chunk)))
                nonlocal held
                held += len(chunk) + len(found)
                if len(plain) + len(spaced) >= CHUNKS or held >= CHUNK_BYTES:       # a cache only: word numbers stay
                    plain.clear()
                    spaced.clear()
                    held = 0
                if len(found) < CHUNK_BYTES:
                    self[chunk] = found
                return found

        def number(word: str) -> bytes:
            k = index.get(word)
            return (own.setdefault(word, n + len(own)) if k is None else k).to_bytes(4, "little")
        plain, spaced, docs, chars = Chunks(""), Chunks(" "), [], 0

        def numbered(text: str | None) -> bytes:
            parts = cut_at_spaces(text) if text else []
            if parts is None:
                return b"".join(map(plain.__getitem__, chunks_of(text)))
            rest = iter(parts)
            return plain[next(rest, "")] + b"".join(map(spaced.__getitem__, rest))

        def flush():
            nonlocal docs, chars, sent
            fresh = [w.encode("utf-8", "surrogatepass") for w in islice(own, sent, None)]
            yield from _word_rows(fresh, ranks, not sent)
            sent = len(own)
            for k in range(0, len(docs), common.OUT_ROWS):
                some = docs[k:k + common.OUT_ROWS]
                yield pa.RecordBatch.from_arrays([
                    pa.array([d for d, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary()),
                    pa.nulls(len(some), _ROWS.field("bytes").type), pa.nulls(len(some), _ROWS.field("known").type)], schema=_ROWS)
            docs, chars = [], 0

        for batch in batches:
            for doc_id, text in _in_slices(batch):
                docs.append((doc_id, numbered(text)))
                chars += len(text or "")
                if len(own) >= BLOCK_WORDS:
                    yield from flush()
                    for numbers in (own, plain, spaced):
                        numbers.clear()
                    held = sent = 0
                elif chars >= FLUSH_CHARS:
                    yield from flush()
        yield from flush()
    return run


@dataclass(frozen=True)
class SharedTable:
    """The shared words in a few flat buffers; it is broadcast, and each worker takes out what it needs."""
    words: bytes
    word_ends: array
    ids: array
    id_ends: array

    @classmethod
    def of(cls, folded: pa.Table) -> "SharedTable":
        """From rows of ``ids`` and ``decoded``, laid end to end without a Python object per word."""
        words, ids, sizes = [], [], ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for batch in folded.to_batches():
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("ids", "decoded")}
            for k in range(batch.num_rows):
                values, ends = _byte_parts(column["decoded"], k)
                words.append(values.tobytes())
                sizes[0].append(np.diff(ends, prepend=0))
                values, ends = _list_parts(column["ids"], k)
                ids.append(values.to_numpy().astype(np.uint32).tobytes())
                sizes[1].append(np.diff(ends, prepend=0))
        word_ends, id_ends = (array("I", np.cumsum(np.concatenate(n)).astype(np.uint32).tobytes()) for n in sizes)
        return cls(b"".join(words), word_ends, array("I", b"".join(ids)), id_ends)

    def __len__(self) -> int:
        return len(self.word_ends)

    def index(self) -> dict[str, int]:
        return {self.words[a:b].decode(): k for k, (a, b) in enumerate(zip([0, *self.word_ends], self.word_ends))}


class Flat:
    """Values of numbered words laid end to end, with the end of each; ``gather`` lays those of a
    document's words end to end."""

    def __init__(self, values: np.ndarray, ends: np.ndarray):
        self.values, self.ends = values, ends.astype(np.int64)
        self.sizes = np.diff(self.ends, prepend=0)

    def joined(self, values: list[np.ndarray], ends: list[np.ndarray]) -> "Flat":
        at, moved = len(self.values), [self.ends]
        for v, e in zip(values, ends):
            moved.append(e + at)
            at += len(v)
        return Flat(np.concatenate([self.values, *values]), np.concatenate(moved))

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        size = self.sizes[numbers]
        ends = np.cumsum(size)
        first = self.ends[numbers] - ends                     # ends - size, less the place in the result
        return self.values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first, size)]


def _decimals(path: str) -> Flat:
    """Every id in decimal digits with a space behind."""
    digits = [b"%d " % i for i in range(max(load_ranks(path).values()) + 1)]
    return Flat(np.frombuffer(b"".join(digits), np.uint8), np.cumsum([len(d) for d in digits]))


def _list_parts(column: pa.Array, k: int) -> tuple[pa.Array, np.ndarray]:
    """Row k of a list of lists: (values, ends)."""
    lists = column[k].values
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets[1:] - offsets[0]


def _byte_parts(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row k of a list of byte strings: (bytes, ends)."""
    items = column[k].values.cast(pa.binary())
    offsets = np.frombuffer(items.buffers()[1], np.int32)[items.offset:items.offset + len(items) + 1].astype(np.int64)
    held = items.buffers()[2]
    values = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return values, offsets[1:] - offsets[0]


_TAKEN: dict[str, tuple] = {}


def _once(name: str, held, make):
    """What a worker made of a broadcast table, kept for its next tasks."""
    key = held._path if hasattr(held, "_path") else id(held)
    if _TAKEN.get(name, (None,))[0] != key:
        _TAKEN[name] = key, make(held.value)
    return _TAKEN[name][1]


def shared_table(docs: DataFrame, path: str, pattern: str, max_words: int = SHARED_WORDS, sample_chars: int = SHARED_SAMPLE) -> SharedTable:
    """The commonest words of a sample, folded and decoded."""
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    part = F.lit(int(1_000_000 * min(1.0, sample_chars / total)) if total else 0)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found = _finder(pattern), Counter()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

        for batch in batches:
            for k in range(0, batch.num_rows, 2048):          # only some texts at a time become Python strings
                seen = Counter()
                for (text,) in common.rows_of(batch.slice(k, 2048), "text"):
                    seen.update(chunks_of(text))
                for chunk, n in seen.items():
                    for w in find(chunk) if len(chunk) <= 200 else ():
                        if len(w) <= SHARED_BYTES:
                            found[w] += n
                del seen
                if len(found) > 100_000:
                    yield batch_of()
                    found.clear()
        yield batch_of()

    counts = (docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < part)
              .mapInArrow(count, "word string, n long").where(F.octet_length("word") <= SHARED_BYTES)
              .groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2").checkpoint())
    # the least count that at most max_words words reach
    size, least = 0, None
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect():
        if size + r["count"] > max_words:
            break
        size, least = size + r["count"], r["n"]
    if least is None:
        return SharedTable(b"", *(array("I") for _ in range(3)))
    words = counts.where(F.col("n") >= least).select("word")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            yield from _word_rows([w.encode() for (w,) in common.rows_of(batch, "word")], ranks)

    folded = encoded_and_decoded(words.mapInArrow(rows, _ROWS_DDL), path).select("ids", "decoded")
    return SharedTable.of(folded.toArrow())                   # one job: each job ships the rank tables anew


def _assemble(path: str, shared, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_ids else []))

    def shared_parts(table: SharedTable) -> tuple[Flat, Flat, Flat]:
        """(decimal digits of all ids, ids of the shared words, their bytes)"""
        return (_decimals(path), Flat(np.array(table.ids, np.int32), np.array(table.id_ends, np.int64)),
                Flat(np.frombuffer(table.words, np.uint8), np.array(table.word_ends, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = common.Collector(schema)
        decimals, shared_ids, shared_bytes = _once("words", shared, shared_parts)
        ids, pieces, own = shared_ids, shared_bytes, ([], [], [], [])
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "words", "ids", "decoded")}
            for k in range(batch.num_rows):
                if column["ids"][k].is_valid:                 # words
                    if column["words"][k].as_py() == _FRESH:
                        ids, pieces = shared_ids, shared_bytes
                    values, ends = _list_parts(column["ids"], k)
                    for parts, new in zip(own, (values.to_numpy(), ends, *_byte_parts(column["decoded"], k))):
                        parts.append(new.copy())
                    continue
                if own[0]:
                    ids, pieces = ids.joined(own[0], own[1]), pieces.joined(own[2], own[3])
                    own = ([], [], [], [])
                numbers = np.frombuffer(column["words"][k].as_py(), "<u4")
                digits, text, n, held, last = hashlib.sha256(), hashlib.sha256(), 0, [], b""
                for at in range(0, len(numbers), GATHER_WORDS):
                    some = numbers[at:at + GATHER_WORDS]
                    found, raw = ids.gather(some), pieces.gather(some).tobytes()
                    spelled = last + decimals.gather(found).tobytes()
                    digits.update(spelled[:-1])
                    last = spelled[-1:]                       # the space behind the last id is none
                    text.update(raw)
                    n += len(found)
                    if with_ids:
                        held.append((found, raw))
                row = (column["doc_id"][k].as_py(), n, digits.hexdigest(), text.hexdigest())
                if out.add(*row, *([[i for f, _ in held for i in f.tolist()], b"".join(r for _, r in held)] if with_ids else [])):
                    yield from out.flush()
        yield from out.flush()

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return run, ddl + (", ids array<int>, decoded binary" if with_ids else "")


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode ``docs(doc_id, text)``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``
    (and ``ids, decoded``), as a rank-file encoder without special tokens does.

    Null and empty texts have no tokens; repeated ids and rows each give a row; other columns are
    not read; an empty table gives no rows; words over ``FOLD_BYTES`` bytes are merged by a heap."""
    checkpoint_dir(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(shared_table(docs, ranks_path, pattern))
    split = docs.select("doc_id", "text").mapInArrow(_split(ranks_path, pattern, shared), _ROWS_DDL)
    run, schema = _assemble(ranks_path, shared, with_ids)
    return encoded_and_decoded(split, ranks_path).mapInArrow(run, schema)
