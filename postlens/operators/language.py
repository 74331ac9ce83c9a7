"""Language of short texts from character n-grams, learned from labelled texts.

Training is one Spark job over all texts: words are counted per language first, so the n-grams of a word
are taken once however often it occurs.  Scoring is naive Bayes over the n-grams of all words; a word's
score depends on the word alone, so each Arrow batch looks words up in a cache.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lengths of n-grams, n-grams the model holds at most (the commonest; it is broadcast), words a task remembers.
LENGTHS, MAX_GRAMS, CACHE_WORDS = (1, 2, 3), 200_000, 200_000
WORD = r"\p{L}+"


@dataclass(frozen=True)
class LanguageModel:
    """``scores[gram]``: log probabilities in the languages ``langs``; ``priors``: those of the languages."""
    langs: tuple[str, ...]
    priors: np.ndarray
    scores: dict[str, np.ndarray]

    def word(self, word: str) -> np.ndarray:
        padded, total = f"_{word}_", np.zeros(len(self.langs))
        for k in LENGTHS:
            for i in range(len(padded) - k + 1):
                found = self.scores.get(padded[i:i + k])
                if found is not None:
                    total += found
        return total


def word_grams(word: Column) -> Column:
    """N-grams of a word between two marks, the mark alone left out."""
    padded = F.concat(F.lit("_"), word, F.lit("_"))
    grams = F.flatten(F.array(*[F.regexp_extract_all(padded, F.lit(f"(?=(.{{{k}}}))"), F.lit(1)) for k in LENGTHS]))
    return F.filter(grams, lambda g: g != "_")


def train_language_model(df: DataFrame, text_col: str, lang_col: str, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """From all rows with a text and a language; log((count + 1) / (all counts + n-grams)) per language."""
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.lower(text_col).alias("t"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = tuple(sorted(sizes))
    words = rows.select("lang", F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    grams = words.select("lang", "count", F.explode(word_grams(F.col("word"))).alias("gram")).groupBy("gram").agg(
        *[F.sum(F.when(F.col("lang") == g, F.col("count")).otherwise(0)).alias(f"c{k}") for k, g in enumerate(langs)], F.sum("count").alias("n"))
    found = grams.orderBy(F.desc("n"), "gram").limit(max_grams).collect() if langs else []
    counts = np.array([[r[f"c{k}"] for k in range(len(langs))] for r in found], np.float64).reshape(len(found), len(langs))
    logs = np.log(counts + 1) - np.log(counts.sum(0) + max(1, len(found)))
    total = sum(sizes.values())
    return LanguageModel(langs, np.array([math.log(sizes[g] / total) for g in langs]), dict(zip((r["gram"] for r in found), logs)))


def guess_language_ngrams(df: DataFrame, text_col: str, model: LanguageModel, out_col: str = "guess", unknown: str = "unknown") -> DataFrame:
    """The likeliest language of each text (ties: the first name); ``unknown`` without a letter."""
    held = df.sparkSession.sparkContext.broadcast(model)       # at most MAX_GRAMS n-grams

    @F.pandas_udf(T.StringType())
    def guess(texts: pd.Series) -> pd.Series:
        import regex
        m, known, out = held.value, {}, []
        find = regex.compile(WORD).findall
        for text in texts:
            words = find(text) if text and m.langs else []
            total = m.priors.copy()
            for w in words:
                if w not in known:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = m.word(w)
                total += known[w]
            out.append(m.langs[int(total.argmax())] if words else unknown)
        return pd.Series(out, dtype=object)

    return df.withColumn(out_col, guess(F.lower(text_col)))
