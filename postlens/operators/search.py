"""Projection, filter and search operators: post search options compiled to
one Column predicate, label encoding, default columns, head and status report.

Search re-aims the crawler's query builder: instead of a search URL for a third-party site, the
options become a single conjunctive predicate over stored posts, so Catalyst can push the time
bounds into the scan and evaluate the text tests inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.sampling import exact_rank

W = r"[\p{L}\p{N}_]"

# The filter names the search options accept.
FILTERS = ("media", "twimg", "images", "videos", "periscope", "native_video", "vine",
           "consumer_video", "pro_video", "verified", "blue_verified", "follows", "social",
           "trusted", "safe", "news", "spaces", "replies", "retweets", "nativeretweets", "quote",
           "links")
EXCLUSIVE = ("includes", "excludes", "either", "exact", "plaintext")


@dataclass
class SearchOptions:
    plaintext: str | None = None
    by: str | None = None
    replies: str | None = None
    mentions: str | None = None
    exact: str | None = None
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    either: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    since: str | _dt.date | None = None
    until: str | _dt.date | None = None
    timeline: str = "LATEST"

    def validate(self) -> "SearchOptions":
        """Exactly one of includes / excludes / either / exact / plaintext; known filters;
        timeline TOP or LATEST."""
        given = [k for k in EXCLUSIVE if getattr(self, k)]
        if len(given) != 1:
            raise ValueError(f"exactly one of {EXCLUSIVE} must be set, got {given}")
        bad = [f for f in self.filters if f.strip().lower() not in FILTERS]
        if bad:
            raise ValueError(f"unknown filters {bad}")
        if self.timeline not in ("TOP", "LATEST"):
            raise ValueError("timeline must be TOP or LATEST")
        return self


def _q(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def word_pattern(phrase: str) -> str:
    """Case-insensitive whole-word (or whole-phrase) pattern; RE2- and Java-compatible."""
    return f"(?i)(^|[^\\p{{L}}\\p{{N}}_]){_q(phrase)}($|[^\\p{{L}}\\p{{N}}_])"


def any_word_pattern(phrases) -> str:
    alts = "|".join(_q(p) for p in phrases)
    return f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({alts})($|[^\\p{{L}}\\p{{N}}_])"


def has_word(c: Column, phrase: str) -> Column:
    return c.rlike(word_pattern(phrase))


# Heuristic filter tests on the text when no boolean column ``filter_<name>`` is present.
_TEXT_FILTERS = {
    "links": lambda c: c.rlike(r"(?i)https?://"),
    "replies": lambda c: c.rlike(r"^@"),
    "retweets": lambda c: c.rlike(r"(?i)^rt\s"),
    "nativeretweets": lambda c: c.rlike(r"(?i)^rt\s"),
}


def search_predicate(opts: SearchOptions, df: DataFrame, content: str = "content",
                     author: str = "author", time: str = "time") -> Column:
    """The options as one predicate.  ``plaintext`` overrides everything (all its words)."""
    opts.validate()
    c = F.col(content)
    if opts.plaintext:
        pred = F.lit(True)
        for w in opts.plaintext.split():
            pred = pred & has_word(c, w)
        return pred
    pred = F.lit(True)
    if opts.by:
        pred = pred & (F.lower(F.col(author)) == opts.by.lower())
    if opts.replies:
        target = F.col("reply_to") if "reply_to" in df.columns else None
        pred = pred & ((F.lower(target) == opts.replies.lower()) if target is not None
                       else c.rlike("(?i)^@" + _q(opts.replies) + "($|[^\\p{L}\\p{N}_])"))
    if opts.mentions:
        pred = pred & has_word(c, "@" + opts.mentions.lstrip("@"))
    if opts.exact:
        pred = pred & F.lower(c).contains(opts.exact.lower())
    for w in opts.includes:
        pred = pred & has_word(c, w)
    for w in opts.excludes:
        pred = pred & ~has_word(c, w)
    if opts.either:
        pred = pred & c.rlike(any_word_pattern([t.strip() for t in opts.either]))
    for f in opts.filters:
        name = f.strip().lower()
        col = f"filter_{name}"
        if col in df.columns:
            pred = pred & F.col(col)
        elif name in _TEXT_FILTERS:
            pred = pred & _TEXT_FILTERS[name](c)
        else:
            raise ValueError(f"filter {name!r} needs a boolean column {col!r}")
    if opts.since is not None:
        pred = pred & (F.col(time) >= F.lit(str(opts.since)).cast("timestamp_ntz"))
    if opts.until is not None:
        pred = pred & (F.col(time) < F.lit(str(opts.until)).cast("timestamp_ntz"))
    return pred


def engagement(df: DataFrame) -> Column:
    cols = [c for c in ("like_count", "repost_count", "comment_count") if c in df.columns]
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0))


def search_posts(df: DataFrame, opts: SearchOptions, content: str = "content",
                 author: str = "author", time: str = "time", limit: int | None = None) -> DataFrame:
    """Matching posts, newest first (LATEST) or by engagement then time (TOP)."""
    out = df.where(search_predicate(opts, df, content, author, time))
    if opts.timeline == "TOP" and any(c in df.columns for c in ("like_count", "repost_count", "comment_count")):
        out = out.orderBy(engagement(df).desc(), F.col(time).desc())
    else:
        out = out.orderBy(F.col(time).desc())
    return out.limit(limit) if limit else out


# ---------------------------------------------------------------- B1–B3, B9

def equals(df: DataFrame, col: str, value) -> DataFrame:
    """B1: equality filter (pushed into the Parquet scan)."""
    return df.where(F.col(col) == F.lit(value))


def _order_bucket(dim: DataFrame, col: str, buckets: int = 4096) -> Column:
    """A bucket that never falls while the column rises."""
    kind = dim.schema[col].dataType.simpleString()
    if kind == "string":
        return F.substring(F.col(col), 1, 2)
    x = (F.unix_date(col) if kind == "date" else F.col(col).cast("int") if kind == "boolean"
         else F.col(col).cast("timestamp") if kind == "timestamp_ntz" else F.col(col)).cast("double")
    finite = F.when(F.abs(x) < float("inf"), x)
    lo, hi = dim.agg(F.min(finite), F.max(finite)).first()
    if lo is None:
        return x
    step = F.floor((x - lo) / max((hi - lo) / buckets, 1e-300))
    return F.when(F.isnan(x) | (x > hi), F.lit(buckets + 1)).when(x < lo, F.lit(-1)).otherwise(step).cast("long")


def encode_labels(df: DataFrame, col: str, out_col: str | None = None,
                  names: list[str] | None = None) -> DataFrame:
    """B2: class name → index.  With ``names`` the order is given; otherwise the sorted distinct
    values, by an exact rank in buckets of their first characters or of their range."""
    out_col = out_col or f"{col}_id"
    if names is not None:
        lookup = F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(i))])
        return df.withColumn(out_col, lookup[F.col(col)])
    dim = df.select(col).where(F.col(col).isNotNull()).distinct()
    dim = exact_rank(dim, [col], _order_bucket(dim, col), rank_col="_rank")
    dim = dim.select(col, (F.col("_rank") - 1).cast("int").alias(out_col))
    return df.join(dim, col, "left")


def with_defaults(df: DataFrame, defaults: dict, overwrite: bool = False) -> DataFrame:
    """Add constant columns that are absent (or reset them with ``overwrite``)."""
    out = df
    for c, v in defaults.items():
        if overwrite or c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    return out


def head(df: DataFrame, n: int = 5, order_col: str = "tweet_id") -> DataFrame:
    """The first n rows by an explicit order (Spark has no row order of its own)."""
    return df.orderBy(order_col).limit(n)


# ---------------------------------------------------------------- B7: status report

def status_report(log: DataFrame, posts: DataFrame, run_id: str | None = None) -> DataFrame:
    """The latest run (by ``started_at``) or the given run, its three dates, and the number
    of stored posts.  One join of two one-row aggregates on a constant key."""
    lg = log if run_id is None else log.where(F.col("run_id") == run_id)
    latest = lg.agg(F.max_by(F.struct("run_id", "started_at", "smallest_date", "timeline_start_date"),
                             F.col("started_at")).alias("r"))
    latest = latest.select(F.col("r.run_id").alias("run_id"),
                           F.col("r.started_at").alias("parsing_start_date"),
                           F.col("r.smallest_date").alias("current_timeline_from"),
                           F.col("r.timeline_start_date").alias("current_timeline_until"))
    cnt = posts.agg(F.count(F.lit(1)).alias("document_count"))
    return latest.withColumn("_k", F.lit(1)).join(cnt.withColumn("_k", F.lit(1)), "_k").drop("_k")


def latest_posts(posts: DataFrame, n: int = 10, order_col: str = "created_at",
                 tiebreak: str = "tweet_id") -> DataFrame:
    """The n newest posts (a top-k: TakeOrderedAndProject, no full sort)."""
    return posts.orderBy(F.col(order_col).desc(), F.col(tiebreak).desc()).limit(n)
