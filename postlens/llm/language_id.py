"""Operator 13: language identification by prediction by partial matching.

Every language gets a context tree over bytes: a node is a context of up to ``ORDER`` bytes, with the
counts of the bytes that followed it in the language's training texts.  A byte that a context knows costs
log2((n + d) / count) bits — n bytes followed it, d different ones; a byte it does not know costs an escape,
log2((n + d) / d) bits, and is tried in the context without its oldest byte; a context that the tree does
not hold costs nothing; at the root, unknown bytes share the escape evenly.  The statistics are frozen once
learned, so the code length of a text is an exact sum, kept in whole units of 1/1024 bit: it depends on
neither order nor partitioning.  The language with the shortest code, plus the bits of its own share of the
training documents, wins.

Training counts are a Spark job over a bounded, documented sample of labelled texts; nodes seen once in
contexts of two bytes and more are not grown, and the least count rises until the trees of all languages
together fit ``MODEL_CELLS``.  For scoring, the trees are laid side by side: one hash table per order maps a
context with its next byte to a row with the whole cost — escapes included — in every language, so a
position takes one look-up in the table of the longest context and goes on to shorter ones only where no
language knows the byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm import common
from postlens.session import checkpoint_dir

ORDER = 4
#: Training rows of a language at most, and numbers (nodes x languages) the trees may have in all.
MAX_ROWS, MODEL_CELLS = 2_000, 16_000_000
UNIT = 1024
UNKNOWN = "und"
#: Bytes handled at once, and numbers (bytes x languages) held while scoring.
PIECE_BYTES, PIECE_CELLS = 1 << 20, 4 << 20
_LETTER = r"\p{L}"
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------------------ grams

def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """For every position from ``ORDER`` on: the ``order`` bytes before it and the byte itself, packed."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(order, -1, -1):
        out = (out << np.uint64(8)) | data[ORDER - k:len(data) - k].astype(np.uint64)
    return out


def _pieces(texts: list[bytes | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, text of each byte), the first ``ORDER`` bytes being context only.  A text starts after
    ``ORDER`` line feeds; these have the text number -1, as has the context that a later piece begins with."""
    start = np.full(ORDER, 10, np.uint8)
    parts, owners, held = [start], [], 0
    for i, text in enumerate(texts):
        data = np.frombuffer(text or b"", np.uint8)
        for at in range(0, len(data), size):
            part = data[at:at + size]
            parts.append(part)
            owners.append(np.full(len(part), i, np.int64))
            held += len(part)
            if held >= size:
                whole = np.concatenate(parts)
                yield whole, np.concatenate(owners)
                parts, owners, held = [whole[-ORDER:]], [], 0
        parts.append(start)
        owners.append(np.full(ORDER, -1, np.int64))
    if held:
        yield np.concatenate(parts), np.concatenate(owners)


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams by language and order, summed over a piece."""
    for batch in batches:
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        texts = _binary(batch, "text")
        for lang in sorted(set(langs)):
            for data, owner in _pieces([texts[i] for i in np.flatnonzero(langs == lang)], PIECE_BYTES):
                for order in range(ORDER + 1):
                    gram, n = np.unique(_grams(data, order)[owner >= 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(np.full(len(gram), order, np.int32)),
                                                      pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "ord", "gram", "n"])


# ------------------------------------------------------------------------------ the model

class GramTable:
    """Open-addressing hash table from packed grams to row numbers."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)       # no gram has eight bytes
        self.rows = np.full(1 << bits, -1, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while todo.size:
            free = self.rows[at[todo]] < 0
            slots, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots], self.rows[slots] = keys[placed], placed
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self._home(keys)
        row = self.rows[at]
        open_ = np.flatnonzero((row >= 0) & (self.keys[at] != keys))
        while open_.size:
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            row[open_] = self.rows[at[open_]]
            open_ = open_[(row[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return row


class ContextTrees:
    """The trees of all languages, laid side by side.  ``costs[k]``: rows of whole costs of the grams of
    order k; ``escapes[k]``: rows of escape costs of the contexts of k bytes."""

    def __init__(self, langs: list[str], priors: np.ndarray, counts: pd.DataFrame):
        self.langs, self.priors = langs, priors
        number = {name: i for i, name in enumerate(langs)}
        lang, order = counts["lang"].map(number).to_numpy(np.int64), counts["ord"].to_numpy()
        gram, n = counts["gram"].to_numpy(np.int64).astype(np.uint64), counts["n"].to_numpy(np.float64)
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            here = order == k
            keys, row = np.unique(gram[here], return_inverse=True)
            if not k:                                          # every byte has a cost at the root
                keys, row = np.arange(256, dtype=np.uint64), gram[here].astype(np.int64)
            seen = np.zeros((len(keys), len(langs)))
            seen[row, lang[here]] = n[here]
            above, context = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(above), len(langs))), np.zeros((len(above), len(langs)))
            np.add.at(total, context, seen)
            np.add.at(kinds, context, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
                known = np.log2((total + kinds)[context] / seen)
            escape = np.rint(escape * UNIT).astype(np.int32)
            if k:
                short = self.grams[k - 1].find(keys & np.uint64((1 << (8 * k)) - 1))      # a gram's end is a gram of its own
                other = escape[context] + self.costs[k - 1][short]
            else:
                other = np.where(kinds > 0, escape, 0) + 8 * UNIT
            self.grams.append(GramTable(keys))
            self.costs.append(np.where(seen > 0, np.rint(np.where(seen > 0, known, 0) * UNIT), other).astype(np.int32))
            self.contexts.append(GramTable(above))
            self.escapes.append(escape)

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Cost of each position from ``ORDER`` on in each language, in units."""
        cost = np.zeros((len(data) - ORDER, len(self.langs)), np.int32)
        todo = np.arange(len(cost))
        gram = _grams(data, ORDER)
        for k in range(ORDER, -1, -1):
            key = gram[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            row = self.grams[k].find(key)
            found = row >= 0
            cost[todo[found]] += self.costs[k][row[found]]
            todo, key = todo[~found], key[~found]
            if not todo.size:
                break
            above = self.contexts[k].find(key >> np.uint64(8))
            some = above >= 0
            cost[todo[some]] += self.escapes[k][above[some]]
        return cost

    def code_lengths(self, texts: list[bytes | None]) -> np.ndarray:
        """Whole code length of every text in every language, in units."""
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        for data, owner in _pieces(texts, max(1, min(PIECE_BYTES, PIECE_CELLS // len(self.langs)))):
            cost = self.bits(data)[owner >= 0].astype(np.int64)
            owner = owner[owner >= 0]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[owner[first]] += np.add.reduceat(cost, first, axis=0)
        return total


def training_rows(docs: DataFrame, learn: Column, max_rows: int) -> DataFrame:
    """``lang, text``: at most ``max_rows`` different labelled texts of each language, by a hash of the
    text; copies count once."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(_LETTER)).select(
        "lang", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"))
    sizes = rows.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(4.0 * max_rows) / F.col("count")) * float(1 << 63)
    few = rows.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(F.col("h") <= F.col("share"))   # a row per language
    few = few.dropDuplicates(["lang", "h"])
    first = Window.partitionBy("lang").orderBy("h")
    return few.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_rows).select("lang", "text")


def fit_language_trees(docs: DataFrame, learn: Column, max_rows: int = MAX_ROWS, model_cells: int = MODEL_CELLS) -> ContextTrees:
    """The trees of ``docs(text, lang)``, learned from rows with ``learn``.  Rows with a null lang or a text
    without a letter teach nothing; without any other row there are no languages."""
    sizes = {r["lang"]: r["count"] for r in docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(_LETTER)).groupBy("lang").count().collect()}
    langs = sorted(sizes)
    rows = training_rows(docs, learn, max_rows)
    counts = rows.mapInArrow(_count, "lang string, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")).checkpoint()
    # the least count at which the nodes of all languages fit the model
    steps = counts.where("ord >= 2").groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, held = 2, counts.where("ord < 2").count()
    for r in steps:
        held += r["count"]
        if r["n"] >= 2 and held * max(1, len(langs)) > model_cells:
            least = r["n"] + 1
            break
    kept = counts.where((F.col("ord") < 2) | (F.col("n") >= least)).toArrow().to_pandas()
    share = np.array([sizes[g] for g in langs], np.float64)
    priors = np.rint(-np.log2(share / share.sum()) * UNIT).astype(np.int64) if langs else np.zeros(0, np.int64)
    return ContextTrees(langs, priors, kept.sort_values(["ord", "lang", "gram"]))


def _predict(model):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: ContextTrees = model.value
        names = np.array([*trees.langs, UNKNOWN], object)
        for batch in batches:
            lettered = np.array(batch.column(batch.schema.get_field_index("lettered")).to_pylist(), bool)
            pred, score, bits = np.full(batch.num_rows, len(trees.langs)), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            texts = _binary(batch, "text")
            at = np.flatnonzero(lettered) if trees.langs else np.zeros(0, np.int64)
            if at.size:
                length = trees.code_lengths([texts[i] for i in at])
                whole = length + trees.priors
                pred[at] = whole.argmin(1)                     # ties: the first name
                score[at] = 1 / np.exp2(-(whole - whole.min(1, keepdims=True)) / UNIT).sum(1)
                bits[at] = length[np.arange(len(at)), pred[at]] / UNIT
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(names[pred], pa.string()),
                                              pa.array(score), pa.array(bits)], names=["doc_id", "lang_pred", "score", "code_bits"])
    return run


def predict_language(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """``doc_id, lang_pred, score, code_bits``: one row per row of ``docs(doc_id, text)``.

    ``lang_pred`` is the language with the shortest code of the whole text, shares included (ties: the
    first name), ``score`` its posterior probability, ``code_bits`` the text's code length in it.  A text
    that is null or has no letter gives ``und`` with score 0, as does any text when no language was
    learned.  Repeated rows count each for itself, an empty table gives no rows, other columns are not
    read."""
    model = docs.sparkSession.sparkContext.broadcast(trees)    # at most MODEL_CELLS numbers
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(_LETTER), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, code_bits double")


def identify(docs: DataFrame, held_out: Column, max_rows: int = MAX_ROWS, model_cells: int = MODEL_CELLS) -> DataFrame:
    """Trees learned from the rows of ``docs(doc_id, text, lang)`` without ``held_out`` (null: learned from)
    predict every row's language."""
    checkpoint_dir(docs.sparkSession)
    return predict_language(docs, fit_language_trees(docs, ~F.coalesce(held_out, F.lit(False)), max_rows, model_cells))
