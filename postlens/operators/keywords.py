"""Keyword tables: top hashtags, top 1–5-grams, hashtag re-aggregation and
the term-frequency table behind a word cloud.

Every count is ``explode`` → ``groupBy(token).count()``: Spark combines map-side (partial
aggregation), so a very frequent token sends one row per task to the shuffle, not one per use.
Top-n reports order by count descending, then token ascending, so ties are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.functions.stopwords import DEFAULT_STOPWORDS
from postlens.session import checkpoint_dir


def _top(counts: DataFrame, n: int | None) -> DataFrame:
    ordered = counts.orderBy(F.desc("cnt"), F.asc("token"))
    return ordered.limit(n) if n else ordered


def token_counts(df: DataFrame, tokens_col) -> DataFrame:
    return (df.select(F.explode(tokens_col).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))


def top_hashtags(df: DataFrame, col: str = "content", n: int | None = 10) -> DataFrame:
    """The n most frequent hashtags of the lower-cased texts."""
    return _top(token_counts(df, T.extract_hashtags(F.col(col))), n)


#: Tokens that may be shipped with the plan as the frequent ones; no token holds the mark of the others.
MAX_FREQUENT, _RARE = 20_000, "\0"


def top_ngrams(df: DataFrame, col: str = "content", n: int | None = 10,
               stopwords: Iterable[str] | None = DEFAULT_STOPWORDS,
               n_min: int = 1, n_max: int = 5, min_count: int = 1) -> DataFrame:
    """The n most frequent 1–5-grams; stop words are dropped before n-grams are formed.

    An n-gram occurs no more often than the rarest of its tokens.  So single tokens are counted first; the
    n-th largest count is a bound that every further result must reach, and longer n-grams are formed only
    where all their tokens reach it (ties included): the others never get as far as the shuffle.  Without
    single tokens in the result, without an n, or with more tokens at the bound than a plan should carry,
    all n-grams are counted."""
    toks = T.tokens(F.col(col))
    if stopwords:
        toks = T.drop_stopwords(toks, stopwords)
    # materialise the token array once: the n-gram lambdas refer to it many times per row
    x = df.select(toks.alias("_toks"))
    if n and n_min == 1 and n_max > 1:
        checkpoint_dir(df.sparkSession)
        ones = token_counts(x, F.col("_toks")).where(F.col("cnt") >= min_count).checkpoint()
        best = ones.orderBy(F.desc("cnt")).limit(n).agg(F.count(F.lit(1)).alias("n"), F.min("cnt").alias("cnt")).first()
        bound = best["cnt"] if best["n"] == n else min_count
        often = [r["token"] for r in ones.where(F.col("cnt") >= bound).select("token").limit(MAX_FREQUENT + 1).collect()]
        if len(often) <= MAX_FREQUENT:
            if not often:
                return _top(ones, n)
            marked = F.array_join(F.transform("_toks", lambda t: F.when(t.isin(*often), t).otherwise(F.lit(_RARE))), " ")
            # runs of frequent tokens (no token holds a space): n-grams with a rare one are never formed
            parts = x.select(F.explode(F.split(marked, f" ?{_RARE}(?: {_RARE})* ?")).alias("_m")).where(F.contains("_m", F.lit(" ")))
            runs = parts.select(F.split("_m", " ").alias("_m"))
            more = token_counts(runs, T.ngrams(F.col("_m"), 2, n_max)).where(F.col("cnt") >= bound)
            return _top(ones.where(F.col("cnt") >= bound).unionByName(more), n)
    counts = token_counts(x, T.ngrams(F.col("_toks"), n_min, n_max))
    if min_count > 1:
        counts = counts.where(F.col("cnt") >= min_count)
    return _top(counts, n)


def reaggregate_hashtags(top: DataFrame) -> DataFrame:
    """An n-gram holding hashtags adds its count to each hashtag occurrence in it; other
    n-grams keep their count."""
    tags = F.regexp_extract_all(F.col("token"), F.lit(T.HASHTAG), 0)
    keys = F.when(F.size(tags) == 0, F.array(F.col("token"))).otherwise(tags)
    return (top.select(F.explode(keys).alias("token"), F.col("cnt"))
            .groupBy("token").agg(F.sum("cnt").cast("long").alias("cnt")))


def term_frequencies(df: DataFrame, col: str = "content", n: int | None = 1000,
                     stopwords: Iterable[str] | None = DEFAULT_STOPWORDS,
                     by: str | None = None) -> DataFrame:
    """Hashtags removed, stop words removed, lower-cased words counted; top n overall, or
    top n per value of ``by`` (ranked after aggregation, so the window sees one row per word)."""
    cleaned = T.remove_hashtags(F.col(col))
    if stopwords:
        cleaned = T.remove_stopwords(cleaned, stopwords)
    words = F.transform(T.split_ws(cleaned), lambda w: F.lower(w))
    if by is None:
        return _top(token_counts(df, words), n)
    counts = (df.select(F.col(by), F.explode(words).alias("token"))
              .groupBy(by, "token").agg(F.count(F.lit(1)).alias("cnt")))
    w = Window.partitionBy(by).orderBy(F.desc("cnt"), F.asc("token"))
    ranked = counts.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("rank") <= n) if n else ranked
