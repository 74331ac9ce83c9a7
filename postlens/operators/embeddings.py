"""Text embeddings learned from the corpus and keywords ranked by them.

Words near each other are counted in one Spark job; the counts become positive pointwise mutual
information between words and a bounded set of context words, and the leading singular directions of that
matrix give word vectors.  The decomposition goes through the contexts' product matrix, whose size is fixed
by the model and not by the data: every task adds up its rows' products, the driver takes the eigenvectors.
A text's vector is the mean of its words' vectors, rare words weighing more.  ``encode_with`` plugs in any
other encoder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators.vectors import as_double_array, corpus_centroid, cosine
from postlens.session import checkpoint_dir

WORD = r"[\p{L}\p{N}_]+"
#: Size of the model, which is broadcast: words with a vector and context words (the commonest), dimensions.
MAX_WORDS, CONTEXTS, DIM = 50_000, 1_000, 64
#: Words to each side that count as near, and the share of a word from which on it weighs less than half.
WINDOW, SMOOTH = 5, 1e-3


@dataclass(frozen=True)
class WordVectors:
    """``vectors[index[word]]``, already weighted."""
    index: dict[str, int]
    vectors: np.ndarray

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """Mean vectors; zero for a text without a known word."""
        import regex
        find = regex.compile(WORD).findall
        out = np.zeros((len(texts), self.vectors.shape[1]))
        for i, text in enumerate(texts):
            known = [k for k in map(self.index.get, find(text)) if k is not None] if text else []
            if known:
                out[i] = self.vectors[known].sum(0) / len(known)
        return out


def _pair_counts(words: dict[str, int], contexts: int, window: int):
    """Counts of (word, context word within the window), summed over a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex
        find = regex.compile(WORD).findall
        for frame in frames:
            for at in range(0, len(frame), 512):
                ids = [[words.get(w, -1) for w in find(t)] + [-1] * window for t in frame["t"].iloc[at:at + 512]]
                x = np.array([i for text in ids for i in text], np.int64)
                codes = []
                for d in range(1, window + 1):
                    a, b = x[:-d], x[d:]
                    for p, q in ((a, b), (b, a)):
                        ok = (p >= 0) & (q >= 0) & (q < contexts)
                        codes.append(p[ok] * contexts + q[ok])
                code, n = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64),) * 2
                yield pd.DataFrame({"word": code // contexts, "context": code % contexts, "n": n})
    return run


def learn_word_vectors(df: DataFrame, col: str, dim: int = DIM, max_words: int = MAX_WORDS, contexts: int = CONTEXTS, window: int = WINDOW) -> WordVectors:
    """From all texts of a table.  Words are numbered by falling count (ties: the word), the first ``contexts``
    of them are context words; the vectors do not depend on partitioning."""
    checkpoint_dir(df.sparkSession)
    texts = df.where(F.col(col).isNotNull()).select(F.lower(col).alias("t"))
    counts = texts.select(F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").count()
    found = counts.orderBy(F.desc("count"), "word").limit(max_words).collect()
    index = {r["word"]: k for k, r in enumerate(found)}
    if not found:
        return WordVectors({}, np.zeros((0, dim)))
    contexts = min(contexts, len(found))
    pairs = (texts.mapInPandas(_pair_counts(index, contexts, window), "word long, context long, n long")
             .groupBy("word", "context").agg(F.sum("n").alias("n")).checkpoint())
    rows_of, columns_of = np.zeros(len(found)), np.zeros(contexts)
    for r in pairs.groupBy("word").agg(F.sum("n").alias("n")).collect():             # at most max_words rows
        rows_of[r["word"]] = r["n"]
    for r in pairs.groupBy("context").agg(F.sum("n").alias("n")).collect():
        columns_of[r["context"]] = r["n"]
    total = rows_of.sum()

    def information(word: np.ndarray, context: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.log(n * total / (rows_of[word] * columns_of[context])))

    rows = pairs.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("context", "n"))).alias("row"))     # at most ``contexts`` entries

    def dense(frame: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(frame), contexts))
        for i, (w, row) in enumerate(zip(frame["word"], frame["row"])):
            c, n = (np.array([e[k] for e in row]) for k in ("context", "n"))
            x[i, c] = information(np.full(len(c), w), c, n)
        return x

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((contexts, contexts))
        for frame in frames:
            for at in range(0, len(frame), 1024):
                x = dense(frame.iloc[at:at + 1024])
                g += x.T @ x
        yield pd.DataFrame({"i": range(contexts), "g": list(g)})

    kept = rows.checkpoint()
    product = np.zeros((contexts, contexts))
    parts = kept.mapInPandas(products, "i int, g array<double>").groupBy("i").agg(
        *[F.array(*[F.sum(F.col("g")[k]) for k in range(a, min(a + 100, contexts))]).alias(f"g{a}") for a in range(0, contexts, 100)]).collect()
    for r in parts:                                            # contexts x contexts numbers
        product[r["i"]] = np.concatenate([r[f"g{a}"] for a in range(0, contexts, 100)])
    values, ways = np.linalg.eigh(product)
    order = np.argsort(-values, kind="stable")[:dim]
    ways, values = ways[:, order], np.maximum(values[order], 0)
    ways = ways * np.where(ways[np.abs(ways).argmax(0), np.arange(ways.shape[1])] < 0, -1, 1)          # a fixed sign
    scale = np.where(values > 1e-9, 1 / np.sqrt(np.sqrt(np.maximum(values, 1e-18))), 0)                # left vectors times the root of the values

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at:at + 1024]
                yield pd.DataFrame({"word": part["word"].to_numpy(), "v": list(dense(part) @ ways * scale)})

    vectors = np.zeros((len(found), dim))
    for r in kept.mapInPandas(project, "word long, v array<double>").collect():       # at most max_words vectors
        vectors[r["word"], :len(r["v"])] = r["v"]
    share = np.array([r["count"] for r in found], np.float64)
    share /= share.sum()
    return WordVectors(index, vectors * (SMOOTH / (SMOOTH + share))[:, None])


def encode_with(df: DataFrame, col: str, encoder: Callable[[list[str | None]], np.ndarray], out_col: str = "embedding") -> DataFrame:
    """H1 with any encoder: texts of an Arrow batch → a matrix, one row each; the encoder is shipped to the
    tasks.  Null texts go in as None."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encoder([t if isinstance(t, str) else None for t in texts]), np.float64)), dtype=object)

    return df.withColumn(out_col, run(F.col(col)))


def embed_texts(df: DataFrame, col: str, model: WordVectors, out_col: str = "embedding") -> DataFrame:
    """H1: mean word vectors of the lower-cased texts."""
    held = df.sparkSession.sparkContext.broadcast(model)       # at most MAX_WORDS vectors
    return encode_with(df.withColumn("_lower", F.lower(col)), "_lower", lambda texts: held.value.encode(texts), out_col).drop("_lower")


def rank_keywords(candidates: DataFrame, keyword_col: str, corpus: DataFrame, col: str, model: WordVectors) -> DataFrame:
    """All candidates with the cosine of their vector to the mean vector of the corpus' texts, null for
    those without a known word."""
    centre = corpus_centroid(embed_texts(corpus.where(F.col(col).isNotNull()).select(col), col, model, "_e"), "_e")
    x = embed_texts(candidates, keyword_col, model, "_e").withColumn("_e", as_double_array("_e"))
    return x.join(F.broadcast(centre), F.lit(True), "left").withColumn("similarity", cosine(F.col("_e"), F.col("centroid"))).drop("_e", "centroid")      # one row
