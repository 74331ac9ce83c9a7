"""Sentiment time series: daily ratios, weekly counts, net score, volume trust weighting,
date-range filter and calendar-event overlays (SURVEY §2.5, B6, D7, D8).

Plan shape of the flagship ``weekly_sentiment``: one parquet scan pruned to the time, label and
content columns (relevance and time-range filters pushed into the scan) → partial aggregate per
week → shuffle of one row per week and task → final aggregate → zero-filled week spine generated
from the weekly rows with ``lead`` (one row per week, bounded by the time span, not by the data
volume; no second scan, no join) → projection.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class ids and names of the three-way sentiment label.
SENTIMENT_CLASSES = {0: "negative", 1: "neutral", 2: "positive"}
# Fixed value: the confidence constant of the volume trust factor.
TRUST_C = 500


def week_end(ts: Column) -> Column:
    """Week label = the Sunday that ends the Monday-based week holding ``ts``."""
    return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)


def _labelled(posts: DataFrame, time_col: str, label_col: str) -> DataFrame:
    return posts.where(F.col(time_col).isNotNull() & F.col(label_col).isin(0, 1, 2))


def daily_sentiment_ratios(posts: DataFrame, time_col: str = "time",
                           label_col: str = "sentiment") -> DataFrame:
    """per day, share of each class among rows with a class in 0..2; net = pos − neg."""
    p = _labelled(posts, time_col, label_col)
    s = F.col(label_col)
    n = F.count(F.lit(1))
    out = p.groupBy(F.to_date(F.col(time_col)).alias("date")).agg(
        (F.count(F.when(s == 0, 1)) / n).alias("negative"),
        (F.count(F.when(s == 1, 1)) / n).alias("neutral"),
        (F.count(F.when(s == 2, 1)) / n).alias("positive"),
    )
    return out.withColumn("net_sentiment", F.col("positive") - F.col("negative"))


def weekly_counts(posts: DataFrame, time_col: str = "time", label_col: str = "sentiment",
                  content_col: str | None = "content", spine: bool = True) -> DataFrame:
    """counts per class per week ending Sunday, zero-filled over a full week spine.

    Only rows with a non-null content are counted (the count is over the text column).
    """
    p = _labelled(posts, time_col, label_col)
    if content_col:
        p = p.where(F.col(content_col).isNotNull())
    s = F.col(label_col)
    wk = p.groupBy(week_end(F.col(time_col)).alias("week_end")).agg(
        F.count(F.when(s == 0, 1)).alias("count_neg"),
        F.count(F.when(s == 1, 1)).alias("count_neu"),
        F.count(F.when(s == 2, 1)).alias("count_pos"),
    )
    if not spine:
        return wk
    # Zero-filled spine from the weekly rows themselves (one scan, no join): each week also emits
    # the empty weeks up to the next week present.  The window sees one row per week.
    nxt = F.lead("week_end").over(Window.orderBy("week_end"))
    x = wk.withColumn("_next", nxt)
    x = x.withColumn("_w", F.explode(F.sequence(
        F.col("week_end"), F.coalesce(F.date_sub("_next", 7), F.col("week_end")), F.expr("INTERVAL 7 DAYS"))))
    here = F.col("_w") == F.col("week_end")
    return x.select(F.col("_w").alias("week_end"),
                    *[F.when(here, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
                      for c in ("count_neg", "count_neu", "count_pos")])


def add_scores(weekly: DataFrame, trust_c: float = TRUST_C) -> DataFrame:
    """total volume, net score (pos − neg)/total (0 when empty), trust n/(n+C), weighted."""
    total = F.col("count_neg") + F.col("count_neu") + F.col("count_pos")
    out = weekly.withColumn("relevant", total)
    out = out.withColumn(
        "sentiment_score",
        F.when(F.col("relevant") > 0,
               (F.col("count_pos") - F.col("count_neg")) / F.col("relevant")).otherwise(F.lit(0.0)))
    out = out.withColumn("trust_factor",
                         F.col("relevant") / (F.col("relevant") + F.lit(float(trust_c))))
    return out.withColumn("weighted_sentiment", F.col("sentiment_score") * F.col("trust_factor"))


def filter_date_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """Inclusive range filter on a date column."""
    return df.where(F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def weekly_sentiment(posts: DataFrame, time_col: str = "time", label_col: str = "sentiment",
                     content_col: str | None = "content", relevant_col: str | None = "relevant",
                     trust_c: float = TRUST_C, start: str | None = None,
                     end: str | None = None) -> DataFrame:
    """Flagship: relevant posts → weekly class counts → net score → trust-weighted score."""
    p = posts
    if relevant_col:
        p = p.where(F.col(relevant_col))                                   # B1
    if start is not None and end is not None:
        # Superset pre-filter on the raw timestamp so the scan can skip row groups / partitions;
        # the exact inclusive filter is applied on the week label below.
        lo = _dt.date.fromisoformat(start) - _dt.timedelta(days=7)
        hi = _dt.date.fromisoformat(end) + _dt.timedelta(days=1)
        p = p.where((F.col(time_col) >= F.lit(lo)) & (F.col(time_col) < F.lit(hi)))
    out = add_scores(weekly_counts(p, time_col, label_col, content_col), trust_c)
    if start is not None and end is not None:
        out = filter_date_range(out, "week_end", start, end)
    return out


def point_event_overlay(series: DataFrame, events: DataFrame) -> DataFrame:
    """Calendar point events (date, label) that fall inside the series' week range,
    with the week row that holds them."""
    bounds = series.agg(F.min("week_end").alias("lo"), F.max("week_end").alias("hi"))
    inside = events.join(F.broadcast(bounds),                 # one row: proven size bound
                         F.col("date").between(F.col("lo"), F.col("hi")), "inner")
    inside = inside.select("date", "label", week_end(F.col("date")).alias("week_end"))
    return inside.join(series, "week_end", "left").select(
        "date", "label", "week_end", "relevant", "weighted_sentiment")


def period_event_overlay(series: DataFrame, periods: DataFrame) -> DataFrame:
    """Periods (start, end, label) overlapping the series range, their midpoint day and the
    weekly rows they cover (number of weeks, volume, mean weighted score)."""
    bounds = series.agg(F.min("week_end").alias("lo"), F.max("week_end").alias("hi"))
    p = periods.join(F.broadcast(bounds),
                     (F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")), "inner")
    p = p.select("start", "end", "label",
                 F.date_add(F.col("start"),
                            F.floor(F.datediff("end", "start") / 2).cast("int")).alias("midpoint"))
    s = series.select("week_end", "relevant", "weighted_sentiment")
    # Interval-overlap join: periods are a calendar (small, broadcast); weeks inside [start, end].
    joined = s.join(F.broadcast(p), s.week_end.between(p.start, p.end), "right")
    return joined.groupBy("start", "end", "label", "midpoint").agg(
        F.count("week_end").alias("n_weeks"),
        F.coalesce(F.sum("relevant"), F.lit(0)).cast("long").alias("volume"),
        F.avg("weighted_sentiment").alias("mean_weighted_sentiment"),
    )


def peak_day_events(posts: DataFrame, time_col: str = "time", key_col: str = "content",
                    half_width_days: int = 3):
    """Event calendars derived from the data: for each key, the day with the most posts (ties →
    earliest day) as a point event, and ±``half_width_days`` around it as a period event."""
    from pyspark.sql import Window
    daily = (posts.where(F.col(time_col).isNotNull() & F.col(key_col).isNotNull())
             .groupBy(F.col(key_col).alias("key"), F.to_date(F.col(time_col)).alias("day"))
             .count())
    w = Window.partitionBy("key").orderBy(F.desc("count"), F.asc("day"))
    peak = daily.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    points = peak.select(F.col("day").alias("date"), F.concat(F.col("key"), F.lit(" peak")).alias("label"))
    periods = peak.select(F.date_sub("day", half_width_days).alias("start"),
                          F.date_add("day", half_width_days).alias("end"),
                          F.concat(F.col("key"), F.lit(" wave")).alias("label"))
    return points, periods
