"""Operator 5: quality by weak supervision.

Rules look at counts of a whole text and vote junk, vote good or abstain.  No vote is taken at its
word: expectation-maximisation over all documents estimates, without labels, how often each rule's
votes are right, and a document's verdict is its posterior probability of being good.  An abstention
says nothing.  Votes enter the estimation as counts of vote patterns, a table bounded by the number
of rules (3^rules rows), so the only thing that reaches the driver does not grow with the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from postlens.session import checkpoint_dir

WINDOW = 8
#: A document fails outright below so many words or above this percentage of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Letters (apostrophes and hyphens inside) with at most one mark before and one after.
_PLAIN = re.compile(r"[(\"'¿¡]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:?!)\"']{0,1}")
_SYMBOL = re.compile(r"[#*$%&|<>]")

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper",
           "n_plain", "n_exclaim", "n_stops", "n_pipes",
           "n_same")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows (of ``window`` words) that occur twice or more; 64-bit hashes stand for words."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (h[k:k + n] ^ (h[k:k + n] >> np.uint64(29)))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    np.subtract.at(edge, starts + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_metrics(text: str | None) -> tuple[int, ...]:
    """The numbers of ``METRICS`` of a whole text; a null or empty text has zeros."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(set(words)), sum(map(str.isupper, words)),
            sum(map(bool, map(_PLAIN.fullmatch, words))), text.count("!"), sum(w[-1] in ".!?" for w in words), words.count("|"),
            sum(map(str.__eq__, words, words[1:])))


@pandas_udf(StructType([StructField(m, LongType()) for m in METRICS]))
def _metrics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_metrics(t) for t in texts], columns=list(METRICS), dtype="int64")


#: Declared non-deterministic so that Catalyst evaluates it once per row: a filter on its numbers would
#: otherwise be pushed below the projection with a second copy of the call.
metrics_udf = _metrics.asNondeterministic()


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def base_failed(m) -> Column:
    return (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words"))


def rules(m) -> dict[str, tuple[Column, Column]]:
    """name → (junk condition, good condition); ``m`` gives a metric's column.  Neither: abstain."""
    words, never = m("n_words"), F.lit(False)
    enough = words >= 40
    plain, length = share(m("n_plain"), words), share(m("word_chars"), words)
    runs = share(m("n_same"), words)
    return {
        "prose": ((plain < 0.75) | (enough & (runs > 0.3)), (plain > 0.9) & (runs < 0.1)),
        "runs": (enough & (runs > 0.3), never),
        "symbols": (share(m("n_symbols"), words) > 0.2, never),
        "menus": (share(m("n_pipes"), words) > 0.1, never),
        "capitals": (share(m("n_upper"), words) > 0.5, never),
        "shouting": (share(m("n_exclaim"), words) > 0.3, never),
        "repeats": (share(m("n_repeat_words"), words) > 0.2, never),
        "lines": ((m("n_lines") >= 4) & (share(m("n_dup_lines"), m("n_lines")) > 0.3), never),
        "variety": (enough & (share(m("n_distinct"), words) < 0.1), never),
        "sentences": (enough & (share(m("n_stops"), words) < 0.005), never),
        "word_length": ((words >= 5) & ((length < 2) | (length > 20)), never),
    }


def vote_pattern(m) -> Column:
    """One character a rule: j (junk), g (good) or - (abstains)."""
    return F.concat(*(F.when(junk, "j").when(good, "g").otherwise("-") for junk, good in rules(m).values()))


class VoteModel:
    """Two classes; a rule that votes is right with an accuracy of its own, independently of the other
    rules.  Expectation-maximisation from accuracies of ``START`` and ``GOOD`` good documents; ten
    pseudo-votes at the starting accuracy keep a rule that hardly ever votes near it."""

    START, GOOD, PSEUDO = 0.9, 0.85, 10

    def __init__(self, rounds: int = 500, tolerance: float = 1e-10):
        self.rounds, self.tolerance = rounds, tolerance

    @staticmethod
    def _signs(patterns: list[str]) -> np.ndarray:
        """+1 good, -1 junk, 0 abstains."""
        return np.array([[{"g": 1.0, "j": -1.0, "-": 0.0}[c] for c in p] for p in patterns])

    def _posterior(self, signs: np.ndarray) -> np.ndarray:
        odds = signs @ np.log(self.accuracy / (1 - self.accuracy)) + np.log(self.good / (1 - self.good))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def fit(self, counts: dict[str, int]) -> "VoteModel":
        patterns = list(counts)
        self.accuracy, self.good = np.full(len(patterns[0]) if patterns else 0, self.START), self.GOOD
        n, signs = np.array([counts[p] for p in patterns], float), self._signs(patterns)
        for _ in range(self.rounds if len(patterns) else 0):
            p = self._posterior(signs)
            right = np.where(signs > 0, p[:, None], np.where(signs < 0, 1 - p[:, None], 0.0))
            accuracy = (n @ right + self.START * self.PSEUDO) / (n @ np.abs(signs) + self.PSEUDO)
            accuracy = np.clip(accuracy, 1e-6, 1 - 1e-6)
            moved = np.abs(accuracy - self.accuracy).max()
            self.accuracy, self.good = accuracy, float(np.clip((n @ p) / n.sum(), 1e-6, 1 - 1e-6))
            if moved < self.tolerance:
                break
        return self

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """P(good) of vote patterns."""
        return self._posterior(self._signs(patterns)) if patterns else np.zeros(0)


def fit_posteriors(votes: DataFrame) -> DataFrame:
    """``votes(pattern)`` of all documents → ``pattern, p_good`` (at most 3^rules rows)."""
    rows = votes.groupBy("pattern").count().collect()          # bounded by the rules, not the data
    counts = {r["pattern"]: r["count"] for r in rows}
    model = VoteModel().fit(counts)
    found = list(counts)
    return votes.sparkSession.createDataFrame(list(zip(found, model.posterior(found).tolist())), "pattern string, p_good double")


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, the votes, ``p_good`` and ``kept`` of every row of
    ``docs(doc_id, text)``.

    Null and empty texts have no words and fail the base; repeated ids and rows each give a row; an
    empty table gives no rows; other columns are not read.  The counts are written once to the
    checkpoint folder and read by both the estimation and the result."""
    checkpoint_dir(docs.sparkSession)
    scored = (docs.select("doc_id", metrics_udf("text").alias("q"))
              .select("doc_id", *(F.col("q")[k].alias(k) for k in METRICS)).checkpoint())
    scored = scored.withColumns({"pattern": vote_pattern(F.col), "base_failed": base_failed(F.col)})
    p = fit_posteriors(scored.select("pattern"))
    return (scored.join(F.broadcast(p), "pattern")             # bounded by the rules
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns, ``text`` among them) that pass the base and the posterior.  Rows
    and votes are written once to the checkpoint folder, so every text is counted once."""
    checkpoint_dir(docs.sparkSession)
    m = lambda k: F.col("q")[k]
    # the row travels as one struct, so that no column of it can clash
    scored = docs.select(F.struct("*").alias("row"), metrics_udf("text").alias("q")).select(
        "row", vote_pattern(m).alias("pattern"), base_failed(m).alias("failed")).checkpoint()
    p = fit_posteriors(scored.select("pattern"))
    return (scored.where("not failed").join(F.broadcast(p), "pattern")     # bounded by the rules
            .where(F.col("p_good") >= threshold).select("row.*"))
