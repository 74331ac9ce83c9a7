"""Operator 3: toxicity by a weighted lexicon.

Texts are folded — compatibility forms, case, invisible characters, look-alike letters of other
scripts, digits and signs written for letters — and matched against a lexicon by an Aho-Corasick
automaton.  Terms are words or the beginnings of words; a match must begin a word, and whole-word
terms must end one.  Matches inside an exception phrase do not count.  The weighted matches, plain and
per hundred words, give a score through a logistic curve.

The lexicon is learned from labelled rows: document frequencies of words and word beginnings in toxic
and other documents, kept where the log-odds are large and beyond chance.  Exception phrases (a match
with a neighbouring word) are learned where a phrase is common in clean documents and absent from
toxic ones, and can be given.  Learning takes at most about ``max_rows`` labelled rows, chosen by a
hash of their id; everything else covers all rows.  The model is a few thousand terms at most.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType

from postlens.llm import common
from postlens.session import checkpoint_dir

#: Labelled rows that a fit reads, and terms and exception phrases that it keeps.
MAX_ROWS, MAX_TERMS, MAX_EXCEPTIONS = 20_000, 3_000, 500
STEM_LENGTHS = range(4, 9)
MIN_TOXIC_DOCS, MIN_LOG_ODDS, MIN_Z = 5, math.log(4), 4.0

# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһӏкмтнвгԛԝαβεικνορτυχγ", "aeopcyxijsdhlkmthbrqwabeiknoptuxy"))
LEET = dict(zip("013456789@$!|+", "oieasgtbgasiit"))

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_LOOK = re.compile("[Ͱ-ԯ]")
_MIXED = re.compile(r"[^\W\d_][0-9@$!|+]|[0-9@$!|+][^\W\d_]")
_TOKEN = re.compile(r"[\w@$!|+]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_AFTER, _LAST = re.compile(r" ([^\W\d_]+)"), re.compile(r"([^\W\d_]+)$")
_LOOK_TABLE, _LEET_TABLE = str.maketrans(LOOK_ALIKE), str.maketrans(LEET)

EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum")


def _unleet(m: re.Match) -> str:
    token = m[0]
    core = token.strip("!|+")
    if core.isalpha() or sum(map(str.isalpha, core)) < 2:
        return token
    return token.replace(core, core.translate(_LEET_TABLE), 1)


def fold(text: str | None) -> str:
    """The form that is matched.  l and i are one letter, so 1 can stand for either."""
    if not text:
        return ""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if _LOOK.search(text):
        text = text.translate(_LOOK_TABLE)
    if _MIXED.search(text):
        text = _TOKEN.sub(_unleet, text)
    return text.replace("l", "i")


@dataclass
class ToxicityModel:
    """Weights of words and of word beginnings (folded), exception phrases (folded), the curve."""
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 1.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick
        found = ahocorasick.Automaton()
        for kind, terms in (("exception", dict.fromkeys(map(fold, self.exceptions), 0.0)), ("stem", self.stems), ("word", self.words)):
            for term, weight in terms.items():
                if term:
                    known = found.get(term, [])
                    found.add_word(term, known + [(kind, len(term), weight)])
        if len(found):
            found.make_automaton()
        return found


def matches(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of counted matches; of several that begin at one place the weightiest."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    n = len(folded)
    for last, terms in automaton.iter(folded):
        for kind, size, weight in terms:
            start = last - size + 1
            if start and folded[start - 1].isalpha():
                continue
            ends = last + 1 == n or not folded[last + 1].isalpha()
            if kind == "exception":
                if ends:
                    spared.append((start, last + 1))
            elif (kind == "stem" or ends) and (start not in best or weight > best[start][1]):
                best[start] = (last + 1, weight)
    out, ends, at = [], -1, 0
    spared.sort()
    for a, (b, w) in sorted(best.items()):
        while at < len(spared) and spared[at][0] <= a:         # exceptions that begin no later than the match
            ends = max(ends, spared[at][1])
            at += 1
        if a >= ends:
            out.append((a, b, w))
    return out


def features(automaton, folded: str) -> tuple[float, float, float]:
    """Weighted matches (log), per hundred words, and the logarithm of how many there are."""
    hits = matches(automaton, folded)
    if not hits:
        return 0.0, 0.0, 0.0
    total = sum(w for _, _, w in hits)
    return math.log1p(total), total * 100 / (len(folded.split()) + 50), math.log1p(len(hits))


def training_row(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


@pandas_udf(ArrayType(LongType()))
def _sketch(texts: pd.Series) -> pd.Series:
    """Three minima of hashes over runs of five words: copies and near copies share one or more."""
    out = []
    for text in texts:
        h = np.array([crc32(w.encode()) for w in (text or "").split()], np.uint64)
        n = max(1, len(h) - 4)
        runs = np.zeros(n, np.uint64)
        for k in range(min(5, len(h))):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
        out.append([int(((runs ^ (runs >> np.uint64(31))) * np.uint64(m) >> np.uint64(2)).min())
                    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)])
    return pd.Series(out)


def training_set(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``text, toxic`` of about ``max_rows`` labelled rows, chosen by a hash of the id; of near copies
    one, lest a copied text teach its every word.  Written to the checkpoint folder: the fit reads the
    documents once."""
    checkpoint_dir(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & training_row(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    part = min(1.0, max_rows / n) if n else 0.0
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    found = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")               # bounded by max_rows
             .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))           # of an id's texts the smallest
             .withColumn("s", _sketch("text")).checkpoint())
    ids = found.select("doc_id", "toxic", *(F.col("s")[k].alias(f"s{k}") for k in range(3)))
    for k in range(3):
        ids = ids.groupBy(f"s{k}").agg(F.min(F.struct("doc_id", "toxic", "s0", "s1", "s2")).alias("r")).select("r.*")
    return found.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select("text", "toxic").checkpoint()


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and word beginnings of each document, summed per batch."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for batch in batches:
        counts = Counter(), Counter()
        for text, toxic in common.rows_of(batch, "text", "toxic"):
            words = set(_LETTERS.findall(fold(text)))
            terms = {"=" + w for w in words if len(w) >= 3}
            terms |= {w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k}
            counts[toxic].update(terms)
        terms = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                          pa.array([counts[0][t] for t in terms], pa.int64())], schema=schema)


def learn_lexicon(train: DataFrame, max_terms: int) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with weights."""
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return {}, {}
    counts = train.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    p, q = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    spread = F.sqrt(p * (1 - F.least(p, F.lit(0.999))) / n1 + q * (1 - F.least(q, F.lit(0.999))) / n0)
    rows = (counts.where(F.col("a") >= MIN_TOXIC_DOCS).select("term", "a", F.log(p / q).alias("w"), ((p - q) / spread).alias("z"))
            .where((F.col("w") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "term").limit(max_terms).collect())
    stems = {r["term"]: (r["a"], r["w"]) for r in rows if not r["term"].startswith("=")}
    # of beginnings with nearly the same documents the longest says most precisely what was met
    for s in sorted(stems, key=len, reverse=True):
        shorter = [s[:k] for k in STEM_LENGTHS if k < len(s) and s[:k] in stems]
        for t in shorter:
            if s in stems and stems[s][0] >= 0.9 * stems[t][0]:
                del stems[t]
            elif s in stems and stems[t][1] >= stems[s][1] - 1.0:
                del stems[s]
    words = {r["term"][1:]: r["w"] for r in rows if r["term"].startswith("=")}
    words = {w: v for w, v in words.items() if not any(w.startswith(s) and stems[s][1] >= v - 1.0 for s in stems)}
    return words, {s: w for s, (_, w) in stems.items()}


def _phrase_counts(model: ToxicityModel):
    """Matches with the next or the previous word: phrase → toxic and clean documents."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            counts = Counter(), Counter()
            for text, toxic in common.rows_of(batch, "text", "toxic"):
                folded, phrases = fold(text), set()
                for start, _, _ in matches(automaton, folded):
                    word = _LETTERS.match(folded, start)[0]
                    after = _AFTER.match(folded, start + len(word))
                    before = _LAST.search(folded, folded.rfind(" ", 0, start - 1) + 1, start - 1) if start > 1 and folded[start - 1] == " " else None
                    phrases |= {f"{word} {after[1]}"} if after else set()
                    phrases |= {f"{before[1]} {word}"} if before else set()
                counts[toxic].update(phrases)
            terms = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                              pa.array([counts[0][t] for t in terms], pa.int64())], schema=schema)
    return run


def _feature_rows(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            rows = [(*features(automaton, fold(text)), toxic) for text, toxic in common.rows_of(batch, "text", "toxic")]
            yield pa.RecordBatch.from_arrays([pa.array([float(r[k]) for r in rows]) for k in range(4)], names=["a", "b", "c", "y"])
    return run


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton's method: (intercept, coefficients...)."""
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, beta))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS,
                 exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Learn a model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Only rows of ``training_row`` are used.  Without labels of both kinds the lexicon is empty and
    every text gets a score below one half."""
    train = training_set(docs, labels, max_rows)
    words, stems = learn_lexicon(train, max_terms)
    model = ToxicityModel(words, stems, tuple(exceptions))
    if not words and not stems:
        return model
    common_clean = (train.mapInArrow(_phrase_counts(model), "term string, toxic long, clean long").groupBy("term")
                    .agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a = 0 and b >= 10")
                    .orderBy(F.desc("b"), "term").limit(MAX_EXCEPTIONS).collect())
    model.exceptions += tuple(r["term"] for r in common_clean)
    rows = train.mapInArrow(_feature_rows(model), "a double, b double, c double, y double").toPandas()   # max_rows rows
    model.curve = fit_curve(rows[["a", "b", "c"]].to_numpy(), rows["y"].to_numpy())
    return model


_AUTOMATA: dict[int, tuple] = {}


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Score of a text column, 0 to 1.  Null and empty texts have no matches."""

    @pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if _AUTOMATA.get(0, (None,))[0] != model:             # one automaton per worker
            _AUTOMATA[0] = (model, model.automaton())
        automaton = _AUTOMATA[0][1]
        x = np.array([features(automaton, fold(t)) for t in texts]).reshape(len(texts), 3)
        beta = np.array(model.curve)
        return pd.Series(1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -40, 40))))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    A row without id is not held out and never learned from; repeated ids and rows each give a row;
    an empty table gives no rows; other columns are not read."""
    model = fit_toxicity(docs, labels, **options)
    scored = docs.select("doc_id", F.coalesce(~training_row(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` (all columns, ``text`` among them) that are not predicted toxic."""
    return docs.where(toxicity_score(model, F.col("text")) < 0.5)
