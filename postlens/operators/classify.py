"""Text classification and token work.

The study fine-tunes transformer models on one GPU; here the same task runs as a ``pyspark.ml``
pipeline (tokenizer → term counts → IDF → class-weighted logistic regression) whose fit is a
distributed iterative job, with model selection by macro F1 on a held-out split.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence
from operator import add

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions import text as TX
from postlens.operators import evaluate as E
from postlens.operators.sampling import exact_rank, split_exact
from postlens.session import checkpoint_dir


# ---------------------------------------------------------------- C26: token ids

PAD, UNK = 0, 1
#: Tokens of the highest counts that are looked up by broadcast.
OFTEN = 2_000


def build_vocabulary(df: DataFrame, col: str, max_vocab: int | None = None, min_count: int = 1) -> DataFrame:
    """Vocabulary of the whole corpus: tokens by count (ties by token), ids from 2 (0 = padding,
    1 = unknown).  All tokens unless ``max_vocab`` asks for the commonest; ids come from an exact rank
    in count buckets, so no task orders the whole vocabulary."""
    counts = (df.select(F.explode(TX.tokens(F.col(col))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= min_count))
    ranked = exact_rank(counts.withColumn("_less", -F.col("cnt")), ["_less", "token"],
                        F.struct(F.col("_less"), F.when(F.col("cnt") < 16, F.substring("token", 1, 2)).alias("_t")))
    ids = ranked.select("token", "cnt", (F.col("rank") + 1).cast("int").alias("token_id"))
    return ids.where(F.col("token_id") <= max_vocab + 1) if max_vocab else ids


def encode_tokens(df: DataFrame, id_col: str, col: str, vocab: DataFrame, max_len: int = 128) -> DataFrame:
    """Token ids truncated / padded to ``max_len`` and the attention mask.  Truncation is the
    feature; it comes before the look-up, so later tokens are never shuffled."""
    toks = df.select(id_col, F.posexplode(F.slice(TX.tokens(F.col(col)), 1, max_len)).alias("pos", "token"))
    # the commonest tokens meet a small broadcast table: no task holds all uses of a token
    often = F.col("token_id") <= UNK + OFTEN
    common = vocab.where(often).select("token", F.col("token_id").alias("_often"))
    toks = toks.join(F.broadcast(common), "token", "left").withColumn("token", F.when(F.col("_often").isNull(), F.col("token")))     # OFTEN rows
    rare = toks.where("_often is null").drop("_often").join(vocab.where(~often).select("token", "token_id"), "token", "left")
    ids = toks.where("_often is not null").withColumnRenamed("_often", "token_id").unionByName(rare) \
        .withColumn("token_id", F.coalesce("token_id", F.lit(UNK)))
    seq = ids.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "token_id"))).alias("_s"))
    seq = df.select(id_col).join(seq, id_col, "left")
    real = F.coalesce(F.transform("_s", lambda e: e["token_id"]), F.array().cast("array<int>"))
    n = F.size(real)
    pad = F.array_repeat(F.lit(PAD), F.greatest(F.lit(max_len) - n, F.lit(0)))
    return seq.select(id_col, F.concat(real, pad).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), n),
                               F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - n, F.lit(0)))).alias("attention_mask"))


# ---------------------------------------------------------------- C18: language guess

# Short stop-word profiles used to guess a post's language.
LANG_PROFILES = {
    "en": ("the", "and", "of", "to", "is", "in", "that", "it", "was", "for", "with", "as", "this", "are", "be"),
    "fr": ("le", "la", "les", "des", "et", "un", "une", "du", "de", "que", "qui", "dans", "pour", "est", "au"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "mit", "sich", "von", "auf", "den", "für"),
    "es": ("el", "los", "las", "y", "que", "en", "un", "una", "por", "con", "para", "es", "del", "se", "lo"),
    "id": ("yang", "dan", "di", "ini", "itu", "dengan", "untuk", "tidak", "dari", "dalam", "akan", "ada", "juga", "ke", "karena"),
}


def language_words(c) -> Column:
    """Lower-cased words of a text for the language guess."""
    return F.split(F.lower(c), r"[^\p{L}\p{N}_']+")


def guess_language(df: DataFrame, text_col: str, out_col: str = "guess",
                   profiles: dict[str, Sequence[str]] = LANG_PROFILES, unknown: str = "unknown") -> DataFrame:
    """The language whose stop words occur most often among the text's words (ties → the first
    language in profile order); ``unknown`` when none occurs.  One expression per row, no shuffle."""
    langs = F.array(*map(F.lit, profiles))
    counts = F.transform(F.array(language_words(F.col(text_col))), lambda words: F.array(
        *(F.size(F.filter(words, _member(tuple(ws)))) for ws in profiles.values())))[0]
    best = F.transform(F.array(counts), lambda n: F.when(
        F.array_max(n) > 0, F.element_at(langs, F.array_position(n, F.array_max(n)).cast("int"))).otherwise(F.lit(unknown)))[0]
    return df.withColumn(out_col, F.when(F.col(text_col).isNull(), F.lit(unknown)).otherwise(best))


def _member(ws: tuple[str, ...]):
    return lambda w: w.isin(*ws)


# ---------------------------------------------------------------- C17, E5: word segmentation

#: Fixed value: the segmenter considers pieces of at most so many characters.
SEGMENT_LIMIT = 24
#: Dictionaries of at most so many words are shipped to the tasks; larger ones are joined.
BROADCAST_WORDS = 300_000
#: Tables of at most so many texts and characters ask for their own pieces only (at most ``SEGMENT_LIMIT`` a character).
FEW_ROWS, FEW_CHARS = 256, 20_000


def unigram_counts(df: DataFrame, col: str) -> DataFrame:
    """Word counts of the corpus (the segmentation dictionary), all words."""
    words = F.regexp_extract_all(F.lower(F.col(col)), F.lit(r"[\p{L}\p{N}]+"), 0)
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def _segment(chunk: str, pieces: list[tuple[int, int]], counts: dict[str, int], total: float) -> str:
    """Most probable split of a chunk; unknown pieces cost more the longer they are.  ``pieces``: the (start, end)
    that ``counts`` may know.  Ties: the earlier start."""
    n, unknown = len(chunk), math.log10(10.0 / total)
    alone = [unknown - k for k in range(min(n, SEGMENT_LIMIT), 0, -1)]
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j in pieces:
        c = counts.get(chunk[i:j])
        if c:
            ends.setdefault(j, []).append((i, math.log10(c / total)))
    best, back = [0.0], [0]
    for j in range(1, n + 1):
        first = max(0, j - SEGMENT_LIMIT)
        scores = list(map(add, best[first:], alone[first - j:]))
        for i, score in ends.get(j, ()):
            scores[i - first] = best[i] + score
        top = max(scores)
        best.append(top)
        back.append(first + scores.index(top))
    out, j = [], n
    while j > 0:
        out.append(chunk[back[j]:j])
        j = back[j]
    return " ".join(out[::-1])


def pair_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of neighbouring words, all pairs."""
    words = df.select(F.regexp_extract_all(F.lower(F.col(col)), F.lit(r"[\p{L}\p{N}]+"), 0).alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("first"), F.col("p.b").alias("second")).agg(F.count(F.lit(1)).alias("cnt"))


def _segment_pairs(chunk: str, counts: dict[str, int], pairs: dict[tuple[str, str], int], total: float) -> str:
    """Most probable split when a piece depends on the one before it: p(b | a) = p(a b) / p(a) for known
    pairs, else p(b).  States are the last pieces; ties: the earlier start."""
    def alone(piece: str) -> float:
        c = counts.get(piece)
        return math.log10(c / total) if c else math.log10(10.0 / total) - len(piece)

    n = len(chunk)
    best: list[dict[int, tuple[float, int]]] = [{0: (0.0, -1)}] + [{} for _ in range(n)]      # end → start of the last piece → (score, start before)
    for j in range(1, n + 1):
        for i in range(max(0, j - SEGMENT_LIMIT), j):
            piece = chunk[i:j]
            free, top = alone(piece), None
            for k, (score, _) in best[i].items():
                before = chunk[k:i]
                c = pairs.get((before, piece)) if i and before in counts else None
                s = score + (math.log10(c / total) - alone(before) if c else free)
                if top is None or s > top[0]:
                    top = s, k
            best[j][i] = top
    out, j = [], n
    i = max(best[n], key=lambda k: best[n][k][0]) if n else 0
    while j > 0:
        out.append(chunk[i:j])
        i, j = best[j][i][1], i
    return " ".join(out[::-1])


#: Sizes of a block of texts with a dictionary of its own, bits of the filter of the dictionary's words.
BLOCK_ROWS, BLOCK_BYTES, FILTER_BITS = 2_048, 2 << 20, 1 << 27


def _hashes(joined: str, ends):
    """``(k, starts, hashes)`` for k = 1 … SEGMENT_LIMIT: where the pieces of k characters of all chunks begin, and
    their hashes.  ``ends``: the end of each character's chunk."""
    import numpy as np
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
    for k in range(1, SEGMENT_LIMIT + 1):
        inside = at + k <= ends[at]
        at, h = at[inside], h[inside]
        if not len(at):
            return
        h = (h + codes[at + k - 1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        yield k, at, h


def _place(h, size: int):
    """The hashes' places among ``size`` (a power of two) bits."""
    import numpy as np
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _paired(first, second):
    """Hashes of pairs of pieces."""
    import numpy as np
    h = (first ^ (second >> np.uint64(17))) * np.uint64(0x94D049BB133111EB) + second
    return h ^ (h >> np.uint64(31))


def _ends(chunks: list[str]):
    import numpy as np
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    return lengths, np.cumsum(lengths)


def _word_hashes(words: list[str]):
    """The hashes of words of 1 to ``SEGMENT_LIMIT`` characters and which words they are."""
    import numpy as np
    lengths, upto = _ends(words)
    ends, first, which = (np.repeat(x, lengths) for x in (upto, upto - lengths, np.arange(len(words))))
    found = [(h[whole], which[at[whole]]) for k, at, h in _hashes("".join(words), ends) for whole in [(at == first[at]) & (at + k == ends[at])]]
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _pair_hashes(first: list[str], second: list[str]):
    """The hashes of pairs of words of 1 to ``SEGMENT_LIMIT`` characters."""
    import numpy as np
    sides = []
    for words in (first, second):
        h, which = _word_hashes(words)
        sides.append((np.zeros(len(words), np.uint64), np.zeros(len(words), bool)))
        sides[-1][0][which], sides[-1][1][which] = h, True
    return _paired(sides[0][0], sides[1][0])[sides[0][1] & sides[1][1]]


def _filter_size(n: int) -> int:
    return min(FILTER_BITS, 1 << max(6, (16 * n).bit_length()))


def _word_filter(words: DataFrame, n: int):
    """Bitmap of the places of ``word``, or of the pairs ``first, second``, at most ``FILTER_BITS`` bits: a piece
    without its bit is no word, two without theirs are no pair."""
    import numpy as np
    size, cols = _filter_size(n), [c for c in words.columns if c != "cnt"]

    def places(batches):
        import pyarrow as pa
        for batch in batches:
            texts = [c.to_pylist() for c in batch.columns]
            at = _place(_pair_hashes(*texts) if len(texts) == 2 else _word_hashes(*texts)[0], size)
            yield pa.RecordBatch.from_pydict({"b": pa.array(at >> 3), "v": pa.array((1 << (at & 7)).astype(np.int16))})

    found = words.select(*cols).mapInArrow(places, "b long, v smallint").groupBy("b").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    bits[found["b"].to_numpy()] = found["v"].to_numpy()
    return bits


def _marked(h, bits):
    import numpy as np
    place = _place(h, len(bits) * 8)
    return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0


def _pieces(chunks: list[str], bits):
    """Each chunk with the (start, end) of its pieces that may be words."""
    import numpy as np
    lengths, upto = _ends(chunks)
    joined, starts, sizes = "".join(chunks), [], []
    for k, at, h in _hashes(joined, np.repeat(upto, lengths)):
        at = at[_marked(h, bits)]
        starts.append(at)
        sizes.append(np.full(len(at), k))
    at, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes))
    order = np.argsort(at, kind="stable")
    at, k = at[order], k[order]
    cuts = np.searchsorted(at, upto).tolist()
    base = np.repeat(upto - lengths, lengths)[at] if len(at) else at
    first, last = (at - base).tolist(), (at - base + k).tolist()
    lo = 0
    for chunk, hi in zip(chunks, cuts):
        yield chunk, list(zip(first[lo:hi], last[lo:hi]))
        lo = hi


#: Characters whose neighbouring pieces are held at a time.
PAIR_CHARS = 20_000


def _neighbours(chunks: list[str], bits, pair_bits) -> set[tuple[str, str]]:
    """The neighbouring pieces of chunks that may be pairs, the first a word."""
    import numpy as np
    out, at = set(), 0
    while at < len(chunks):
        upto, size = at, 0
        while upto < len(chunks) and (upto == at or size + len(chunks[upto]) <= PAIR_CHARS):
            size, upto = size + len(chunks[upto]), upto + 1
        lengths, ends = _ends(chunks[at:upto])
        joined, ends, at = "".join(chunks[at:upto]), np.repeat(ends, lengths), upto
        found = list(_hashes(joined, ends))
        words = [(start[some], start[some] + k, h[some]) for k, start, h in found for some in [_marked(h, bits)]]
        first, cut, before = map(np.concatenate, zip(*words)) if words else (np.zeros(0, np.int64),) * 3
        inside = cut < ends[first] if len(first) else np.zeros(0, bool)
        first, cut, before = first[inside], cut[inside], before[inside]
        for k, start, h in found:
            place = np.searchsorted(start, cut)
            fits = np.flatnonzero((place < len(start)) & (start[np.minimum(place, len(start) - 1)] == cut))
            fits = fits[_marked(_paired(before[fits], h[place[fits]]), pair_bits)]
            out.update((joined[i:j], joined[j:j + k]) for i, j in zip(first[fits].tolist(), cut[fits].tolist()))
    return out


def _in_blocks(col: str):
    """Rows → rows with ``_block``: runs of rows of a task, bounded in rows and bytes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    def run(batches):
        block, rows, size = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_pylist()
            for i, n in enumerate(lengths):
                if rows and (rows >= BLOCK_ROWS or size + n > BLOCK_BYTES):
                    block, rows, size = block + 1, 0, 0
                out[i], rows, size = block, rows + 1, size + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "_block"])
    return run


def _wanted(held, by_pairs: bool = False):
    """``_block, text`` → the distinct pieces of each block that may be words beyond the shipped ones, or its
    neighbouring pieces that may be pairs (``first, second``)."""
    import pyarrow as pa
    import regex

    def run(batches):
        find = regex.compile(r"[\p{L}\p{N}]+").findall
        words, _, bits, pair_bits = held.value

        def rare(block, chunks):
            if by_pairs:
                got = list(_neighbours(list(chunks), bits, pair_bits))
                sides = [pa.array([p[k] for p in got], pa.string()) for k in (0, 1)]
                return pa.RecordBatch.from_arrays([pa.array([block] * len(got), pa.int64()), *sides], names=["_block", "first", "second"])
            got = {p for chunk, pieces in _pieces(list(chunks), bits) for i, j in pieces if (p := chunk[i:j]) not in words}
            return pa.RecordBatch.from_pydict({"_block": pa.array([block] * len(got), pa.int64()), "word": pa.array(list(got), pa.string())})

        at, chunks = None, set()
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != at:
                    if chunks:
                        yield rare(at, chunks)
                    at, chunks = block, set()
                chunks.update(find(text or ""))
        if chunks:
            yield rare(at, chunks)
    return run


def _split_texts(texts: list, held, own: dict[str, int] | None, total: float, by_pairs: bool, pairs: dict | None = None) -> list:
    """Lower-cased texts → split texts.  ``own``, ``pairs``: counts of the words and pairs that are not shipped.  A
    worker remembers the chunks it has split: a chunk is split the same way in every block."""
    import regex
    find, done = regex.compile(r"[\p{L}\p{N}]+").findall, _SEGMENTED
    words, known, bits, _ = held
    known = known if pairs is None else pairs
    if done.get("of") is not words or len(done) > BROADCAST_WORDS:
        done.clear()
        done["of"] = words
    parts = [find(t) if isinstance(t, str) else None for t in texts]
    fresh = list({c for chunks in parts for c in chunks or () if (by_pairs, c) not in done})
    for chunk, pieces in _pieces(fresh, bits):
        counts = words if own is None else {p: c for i, j in pieces if (c := words.get(p := chunk[i:j]) or own.get(p))}
        done[by_pairs, chunk] = _segment_pairs(chunk, counts, known, total) if by_pairs else _segment(chunk, pieces, counts, total)
    return [None if chunks is None else " ".join([done[by_pairs, c] for c in chunks]) for chunks in parts]


def _known_pieces(texts: list[str | None], counts: DataFrame) -> tuple[dict[str, int], float]:
    """The counts of all pieces of a few texts that are words, and the sum of all counts: one pass over ``counts``."""
    import regex
    find = regex.compile(r"[\p{L}\p{N}]+").findall
    pieces = {c[i:j] for t in texts if t for c in find(t) for i in range(len(c)) for j in range(i + 1, min(len(c), i + SEGMENT_LIMIT) + 1)}
    wanted = counts.sparkSession.createDataFrame([(p,) for p in sorted(pieces)], "word string")
    marked = counts.join(F.broadcast(wanted.withColumn("_piece", F.col("word"))), "word", "left")
    found = {r["_piece"]: int(r["cnt"] or 0) for r in marked.groupBy("_piece").agg(F.sum("cnt").alias("cnt")).collect()}
    total = float(sum(found.values()))
    found.pop(None, None)
    return found, total


def _known_pairs(texts: list[str | None], words: dict[str, int], pairs: DataFrame) -> dict[tuple[str, str], int]:
    """The counts of all neighbouring pieces of a few texts that are pairs, the first one of ``words``.  They are
    named before the pairs are counted, so no other pair is shuffled or held."""
    import numpy as np
    import pyarrow as pa
    import regex
    find = regex.compile(r"[\p{L}\p{N}]+").findall
    number: dict[str, int] = {}
    asked = {(number.setdefault(c[k:i], len(number)) << 32) | number.setdefault(c[i:j], len(number))
             for c in {c for t in texts if t for c in find(t)} for i in range(1, len(c)) for k in range(max(0, i - SEGMENT_LIMIT), i) if c[k:i] in words
             for j in range(i + 1, min(len(c), i + SEGMENT_LIMIT) + 1)}
    if not asked:
        return {}
    both, names = np.fromiter(asked, np.int64, len(asked)), pa.array(list(number), pa.string())
    wanted = pairs.sparkSession.createDataFrame(pa.table({"first": names.take(pa.array(both >> 32)), "second": names.take(pa.array(both & 0xFFFFFFFF))}))
    return _as_pairs(pairs.join(wanted, ["first", "second"], "left_semi"))


def _as_pairs(pairs: DataFrame) -> dict[tuple[str, str], int]:
    found = pairs.select("first", "second", F.col("cnt").cast("long").alias("cnt")).toArrow()
    return dict(zip(zip(*(found[c].to_pylist() for c in ("first", "second"))), found["cnt"].to_pylist()))


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """The words with counts from the least on that at most ``most`` words reach: no task orders the words."""
    size, least = 0, None
    for r in counts.groupBy(F.least("cnt", F.lit(100_000)).alias("cnt")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("cnt")).collect():
        if size + r["n"] > most:
            break
        size, least = size + r["n"], r["cnt"]
    return counts.limit(0) if least is None else counts.where(F.col("cnt") >= least)


def segment_column(df: DataFrame, col: str, counts: DataFrame, out_col: str = "segmented", pairs: DataFrame | None = None) -> DataFrame:
    """C17: most probable split of each value into dictionary words (``demomahasiswa`` →
    ``demo mahasiswa``), with ``pairs`` (``pair_counts``) by words and their predecessors.

    Of a few short texts only the pieces are looked up, in one pass over the dictionary.  Else the commonest words,
    at most ``BROADCAST_WORDS``, are shipped to the tasks, which remember the chunks they have split;
    a dictionary of that size needs no shuffle.  The words of a larger one are looked up per block of texts: a
    bounded bitmap rules out most pieces that are no words, the others are joined with the dictionary, and each
    block is split with the counts of its own pieces.  More than ``BROADCAST_WORDS`` pairs are looked up in the same
    way.  Texts are shuffled once, whole."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    by_pairs, low = pairs is not None, F.lower(F.col(col))

    def whole(x: DataFrame, held, total: float) -> DataFrame:
        @F.pandas_udf(T.StringType())
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(_split_texts(texts.tolist(), held.value, None, total, by_pairs), dtype=object)

        return x.withColumn(out_col, run(low))

    few = df.select(low.alias("t")).limit(FEW_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    if few["n"] <= FEW_ROWS and few["c"] <= FEW_CHARS:
        import numpy as np
        df = df.checkpoint()
        texts = [r["t"] for r in df.select(low.alias("t")).collect()]
        shipped, total = _known_pieces(texts, counts)
        known = _known_pairs(texts, shipped, pairs) if by_pairs else {}
        return whole(df, spark.sparkContext.broadcast((shipped, known, np.full(8, 255, np.uint8), None)), total or 1.0)
    counts = counts.checkpoint()                              # read several times
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("t")).first()
    total = float(size["t"]) or 1.0
    first = counts if size["n"] <= BROADCAST_WORDS else _commonest(counts, BROADCAST_WORDS)
    shipped = {r["word"]: int(r["cnt"]) for r in first.collect()}
    known, pair_bits, more = {}, None, False
    if by_pairs:
        pairs = pairs.where((F.length("first") <= SEGMENT_LIMIT) & (F.length("second") <= SEGMENT_LIMIT)).checkpoint()
        n = pairs.count()
        if more := n > BROADCAST_WORDS:
            pair_bits = _word_filter(pairs, n)
        else:
            known = _as_pairs(pairs)
    held = spark.sparkContext.broadcast((shipped, known, _word_filter(counts, size["n"]), pair_bits))
    if size["n"] <= BROADCAST_WORDS and not more:
        return whole(df, held, total)
    rest = counts.where(F.length("word") <= SEGMENT_LIMIT)
    # the lower-cased text travels only where it differs
    x = df.withColumn("_low", F.when(low != F.col(col), low))
    kind = T.StructType([*x.schema.fields, T.StructField("_block", T.LongType())])
    x = x.mapInArrow(_in_blocks(col), kind).checkpoint()      # the same blocks for both steps
    lows = x.select("_block", F.coalesce("_low", F.col(col)).alias("t"))
    own = lows.mapInArrow(_wanted(held), "_block long, word string").join(rest, "word").select("_block", F.struct(
        F.col("word").alias("first"), F.lit(None).cast("string").alias("second"), F.col("cnt").cast("long").alias("cnt")).alias("e"))
    if more:
        asked = lows.mapInArrow(_wanted(held, True), "_block long, first string, second string")
        own = own.unionByName(asked.join(pairs, ["first", "second"]).select("_block", F.struct("first", "second", F.col("cnt").cast("long").alias("cnt")).alias("e")))
    own = own.groupBy("_block").agg(F.collect_list("e").alias("_own"))

    def split(texts, found):
        import pyarrow as pa
        mine, ties = {}, {}
        for e in (e for row in found["_own"].to_pylist() for e in row):
            if e["second"] is None:
                mine[e["first"]] = e["cnt"]
            else:
                ties[e["first"], e["second"]] = e["cnt"]
        lows = [a if a is not None else b for a, b in zip(texts["_low"].to_pylist(), texts[col].to_pylist())]
        done = _split_texts(lows, held.value, mine, total, by_pairs, ties if more else None)
        return texts.drop_columns(["_low", "_block"]).append_column(out_col, pa.array(done, pa.string()))

    kind = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    return x.groupBy("_block").cogroup(own.groupBy("_block")).applyInArrow(split, kind)


#: Chunks that a worker has split, for one dictionary at a time.
_SEGMENTED: dict = {}


def reaggregate_segmented(top: DataFrame, counts: DataFrame, n: int = 50) -> DataFrame:
    """E5: hashtags of each n-gram keep their form (count added per occurrence); other n-grams
    are segmented and merged; top ``n``."""
    checkpoint_dir(top.sparkSession)
    top = top.checkpoint()                                    # counted once, read for both kinds
    tags = F.regexp_extract_all(F.col("token"), F.lit(TX.HASHTAG), 0)
    with_tags = top.where(F.size(tags) > 0).select(F.explode(tags).alias("token"), "cnt")
    plain = segment_column(top.where(F.size(tags) == 0), "token", counts, "_seg") \
        .select(F.col("_seg").alias("token"), "cnt").where(F.col("token") != "")
    merged = with_tags.unionByName(plain).groupBy("token").agg(F.sum("cnt").cast("long").alias("cnt"))
    return merged.orderBy(F.desc("cnt"), F.asc("token")).limit(n)


# ---------------------------------------------------------------- H10, H11: classifier

def _weighted(df: DataFrame, label_col: str, mode: str | None, classes: Sequence[int]) -> DataFrame:
    if not mode:
        return df.withColumn("_w", F.lit(1.0))
    w = E.class_weights(df, label_col, mode, classes).withColumnRenamed("class", label_col)
    return df.join(F.broadcast(w), label_col, "left").withColumn("_w", F.coalesce("weight", F.lit(1.0))) \
        .drop("weight")


def text_stages(text_col: str, features: int = 1 << 16) -> list:
    """Hashed term counts: every term has a place, however many there are."""
    return [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"#?[\p{L}\p{N}_]+", gaps=False),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=features)]


def logistic(reg: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=reg,
                              elasticNetParam=0.0, maxIter=50, family="multinomial",
                              probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw")


def _term_counts(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``keep`` and the term counts of each text, written once: every fit and every pass of a fit reads them from
    there, and neither joins, splits nor tokenises again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/terms-{uuid.uuid4().hex}"
    tok, tf = text_stages(text_col)
    tf.transform(tok.transform(df)).select(*keep, "_tf").write.parquet(path)
    return spark.read.parquet(path)


def _whole(text_col: str, idf, lr) -> PipelineModel:
    return PipelineModel([*text_stages(text_col), idf, lr])


def train_classifier(df: DataFrame, text_col: str, label_col: str, id_col: str,
                     classes: Sequence[int] = (0, 1), weights: str | None = "balanced",
                     regs: Iterable[float] = (0.0, 0.01, 0.1), val_share: float = 0.2, seed: int = 42):
    """Class-weighted logistic regression on TF-IDF; the regularisation with the best macro
    F1 on a hash-split validation set wins, then the model is refitted on all rows.  Term counts are made once,
    inverse frequencies once for the training split and once for all rows.
    Returns (model, selection table)."""
    spark = df.sparkSession
    x = _weighted(df.drop("split").withColumn("_y", F.col(label_col).cast("double")), label_col, weights, classes)
    x = _term_counts(split_exact(x, id_col, test=val_share, seed=seed), text_col, label_col, "_y", "_w", "split")
    tr, va = x.where("split = 'train'"), x.where("split = 'test'")
    idf, rows = IDF(inputCol="_tf", outputCol="_x").fit(tr), []
    for reg in regs:
        m = logistic(reg).fit(idf.transform(tr))
        p = m.transform(idf.transform(va)).select(F.col(label_col).alias("label"), F.col("_pred").cast("int").alias("pred"))
        s = E.summary_metrics(p, classes).first()
        rows.append((float(reg), float(s["macro_f1"] or 0.0), float(s["accuracy"] or 0.0)))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    idf = IDF(inputCol="_tf", outputCol="_x").fit(x)
    model = _whole(text_col, idf, logistic(best).fit(idf.transform(x)))
    return model, spark.createDataFrame(rows, "reg_param DOUBLE, macro_f1 DOUBLE, accuracy DOUBLE")


def train_focal(df: DataFrame, text_col: str, label_col: str, classes: Sequence[int], reg: float = 0.01,
                gamma: float = 2.0, rounds: int = 2, weights: str | None = "balanced"):
    """H10 with focal weighting: after a first fit every row is weighted by (1 - p of its class)^gamma
    times its class weight and the model is fitted again, so well-classified rows count less.  Term counts and
    inverse frequencies do not depend on the weights: they are made once."""
    x = _weighted(df.withColumn("_y", F.col(label_col).cast("double")), label_col, weights, classes)
    x = _term_counts(x, text_col, "_y", "_w")
    idf = IDF(inputCol="_tf", outputCol="_x").fit(x)
    lr = logistic(reg).fit(idf.transform(x))
    for _ in range(rounds - 1):
        p = F.element_at(vector_to_array("_prob"), F.col("_y").cast("int") + 1)
        x = lr.transform(idf.transform(x)).withColumn("_w", F.col("_w") * F.pow(F.lit(1.0) - p, gamma) + F.lit(1e-6)).select("_y", "_w", "_tf")
        lr = logistic(reg).fit(idf.transform(x))
    return _whole(text_col, idf, lr)


def score(model, df: DataFrame, n_classes: int = 2) -> DataFrame:
    """Predicted class, confidence and per-class probability columns."""
    out = model.transform(df.withColumn("_w", F.lit(1.0)).withColumn("_y", F.lit(0.0)))
    out = out.withColumn("probabilities", vector_to_array("_prob"))
    out = out.withColumn("pred", F.col("_pred").cast("int")).withColumn("confidence", F.array_max("probabilities"))
    for k in range(n_classes):
        out = out.withColumn(f"prob_{k}", F.col("probabilities")[k])
    return out.drop("_tok", "_tf", "_x", "_raw", "_prob", "_pred", "_w", "_y")


# ---------------------------------------------------------------- H14: self-training round

def self_training_round(posts: DataFrame, train: DataFrame, test: DataFrame, n_unlabelled: int,
                        id_col: str = "tweet_id", label_col: str = "sentiment", seed: int = 42,
                        min_samples: int = 5, min_cluster_size: int = 5, eps_quantile: float = 0.6) -> DataFrame:
    """One expansion round — posts seen in neither split (D5) → exact-size hash sample
    marked unlabelled (B3) → appended to train (G5) → embedded (H1) → density clusters (H5) →
    review blocks (A6) flattened (A4) → unlabelled rows take their cluster's majority (E16) →
    changed labels upserted into train (D3)."""
    from postlens.operators import labels as L
    from postlens.operators.cluster import density_cluster
    from postlens.operators.vectors import embed_text
    pool = L.exclude_seen(posts, [train, test], "content")
    sample = split_exact(pool, id_col, test=int(n_unlabelled), seed=seed).where("split = 'test'").drop("split")
    sample = sample.withColumn(label_col, F.lit(-1))
    cols = [id_col, "content", label_col]
    checkpoint_dir(posts.sparkSession)
    both = train.select(*cols).unionByName(sample.select(*cols)).checkpoint()     # splits and sample made once, read by every step
    emb = embed_text(both, "content", 256)
    cl = density_cluster(emb, id_col, "embedding", min_samples, min_cluster_size, eps_quantile=eps_quantile)
    x = both.join(cl.select(id_col, "cluster", "probability"), id_col)
    flat = L.flatten_review(L.review_export_nested(x, "cluster", label_col, id_col))
    flat = flat.withColumn("status", F.when(F.col("is_unlabeled"), F.lit(L.UNCORRECTED)).otherwise(F.lit(L.CORRECTED)))
    flat = flat.withColumnRenamed("current_label", "label").withColumnRenamed("cluster_id", "cluster")
    labelled = flat.where(~F.col("is_unlabeled"))
    maj = L.cluster_majority(labelled.withColumn("status", F.lit(L.CORRECTED)), "cluster", "label", (0, 1, 2)) \
        .select("cluster", "majority")
    prop = flat.join(maj, "cluster", "left").withColumn(
        "current_label", F.when(F.col("is_unlabeled") & (F.col("cluster") >= 0) & F.col("majority").isNotNull(),
                                F.col("majority")).otherwise(F.col("label")))
    corr = prop.select("tweet_id", "original_label", "current_label")
    src = posts.select(F.col(id_col).cast("string").alias(id_col), "content",
                       F.lit(-1).alias(label_col), F.lit(False).alias("relevant"))
    tr = train.select(F.col(id_col).cast("string").alias(id_col), "content", label_col,
                      F.lit(True).alias("relevant"))
    return L.upsert_corrections(tr, corr, src, id_col, label_col)
