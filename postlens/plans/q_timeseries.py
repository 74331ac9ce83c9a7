"""Catalogue: weekly sentiment (flagship), daily ratios and event overlays over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import timeseries as ts
from postlens.plans.registry import register
from postlens.sources.tables import EVENTS_POSTS_SQL, posts_from_events

# The inclusive week range of the reference's time-series study.
RANGE_START, RANGE_END = "2023-01-01", "2025-05-31"


def weekly_weighted_sentiment(spark, sf_dir):
    return ts.weekly_sentiment(posts_from_events(spark, sf_dir), start=RANGE_START, end=RANGE_END)


_WEEKLY_SQL = f"""
WITH p AS ({EVENTS_POSTS_SQL}),
wk AS (
  SELECT CAST(date_trunc('week', time) AS DATE) + 6 AS week_end,
         count(CASE WHEN sentiment = 0 THEN 1 END) AS count_neg,
         count(CASE WHEN sentiment = 1 THEN 1 END) AS count_neu,
         count(CASE WHEN sentiment = 2 THEN 1 END) AS count_pos
  FROM p
  WHERE relevant AND time IS NOT NULL AND content IS NOT NULL AND sentiment IN (0, 1, 2)
  GROUP BY 1),
sp AS (
  SELECT CAST(unnest(generate_series(CAST(min(week_end) AS TIMESTAMP),
                                     CAST(max(week_end) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM wk),
j AS (
  SELECT sp.week_end, coalesce(count_neg, 0) AS count_neg, coalesce(count_neu, 0) AS count_neu,
         coalesce(count_pos, 0) AS count_pos
  FROM sp LEFT JOIN wk ON sp.week_end = wk.week_end),
s AS (
  SELECT *, count_neg + count_neu + count_pos AS relevant FROM j),
t AS (
  SELECT *, CASE WHEN relevant > 0 THEN (count_pos - count_neg) / relevant ELSE 0.0 END AS sentiment_score,
         relevant / (relevant + 500.0) AS trust_factor
  FROM s)
SELECT week_end, count_neg, count_neu, count_pos, relevant, sentiment_score, trust_factor,
       sentiment_score * trust_factor AS weighted_sentiment
FROM t
WHERE week_end BETWEEN DATE '{RANGE_START}' AND DATE '{RANGE_END}'
"""

register("weekly_weighted_sentiment", _WEEKLY_SQL)(weekly_weighted_sentiment)


@register("daily_sentiment_ratio", f"""
WITH p AS ({EVENTS_POSTS_SQL})
SELECT CAST(time AS DATE) AS date,
       count(CASE WHEN sentiment = 0 THEN 1 END) / count(*) AS negative,
       count(CASE WHEN sentiment = 1 THEN 1 END) / count(*) AS neutral,
       count(CASE WHEN sentiment = 2 THEN 1 END) / count(*) AS positive,
       count(CASE WHEN sentiment = 2 THEN 1 END) / count(*)
         - count(CASE WHEN sentiment = 0 THEN 1 END) / count(*) AS net_sentiment
FROM p WHERE relevant AND time IS NOT NULL AND sentiment IN (0, 1, 2)
GROUP BY 1
""")
def daily_sentiment_ratio(spark, sf_dir):
    posts = posts_from_events(spark, sf_dir).where(F.col("relevant"))
    return ts.daily_sentiment_ratios(posts)


_CAL_SQL = f"""
p AS ({EVENTS_POSTS_SQL}),
daily AS (
  SELECT content AS key, CAST(time AS DATE) AS day, count(*) AS cnt
  FROM p WHERE time IS NOT NULL AND content IS NOT NULL GROUP BY 1, 2),
peak AS (
  SELECT key, day FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY cnt DESC, day ASC) AS rn FROM daily)
  WHERE rn = 1),
wk AS (
  SELECT CAST(date_trunc('week', time) AS DATE) + 6 AS week_end,
         count(CASE WHEN sentiment = 0 THEN 1 END) AS count_neg,
         count(CASE WHEN sentiment = 1 THEN 1 END) AS count_neu,
         count(CASE WHEN sentiment = 2 THEN 1 END) AS count_pos
  FROM p
  WHERE relevant AND time IS NOT NULL AND content IS NOT NULL AND sentiment IN (0, 1, 2)
  GROUP BY 1),
sp AS (
  SELECT CAST(unnest(generate_series(CAST(min(week_end) AS TIMESTAMP),
                                     CAST(max(week_end) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM wk),
j AS (
  SELECT sp.week_end, coalesce(count_neg, 0) + coalesce(count_neu, 0) + coalesce(count_pos, 0) AS relevant,
         coalesce(count_pos, 0) - coalesce(count_neg, 0) AS net
  FROM sp LEFT JOIN wk ON sp.week_end = wk.week_end),
series AS (
  SELECT week_end, relevant,
         (CASE WHEN relevant > 0 THEN net / relevant ELSE 0.0 END) * (relevant / (relevant + 500.0))
           AS weighted_sentiment
  FROM j),
bounds AS (SELECT min(week_end) AS lo, max(week_end) AS hi FROM series)
"""


def _calendar(spark, sf_dir):
    posts = posts_from_events(spark, sf_dir)
    series = ts.weekly_sentiment(posts)
    points, periods = ts.peak_day_events(posts)
    return series, points, periods


@register("point_event_overlay", f"""
WITH {_CAL_SQL},
pts AS (SELECT day AS date, key || ' peak' AS label FROM peak)
SELECT pts.date, pts.label, CAST(date_trunc('week', pts.date) AS DATE) + 6 AS week_end,
       series.relevant, series.weighted_sentiment
FROM pts JOIN bounds ON pts.date BETWEEN bounds.lo AND bounds.hi
LEFT JOIN series ON series.week_end = CAST(date_trunc('week', pts.date) AS DATE) + 6
""")
def point_event_overlay(spark, sf_dir):
    series, points, _ = _calendar(spark, sf_dir)
    return ts.point_event_overlay(series, points)


@register("period_event_overlay", f"""
WITH {_CAL_SQL},
per AS (SELECT day - 3 AS start, day + 3 AS "end", key || ' wave' AS label FROM peak),
kept AS (
  SELECT start, "end", label,
         start + CAST(floor(datediff('day', start, "end") / 2) AS INTEGER) AS midpoint
  FROM per JOIN bounds ON per.start <= bounds.hi AND per."end" >= bounds.lo)
SELECT kept.start, kept."end", kept.label, kept.midpoint,
       count(series.week_end) AS n_weeks,
       CAST(coalesce(sum(series.relevant), 0) AS BIGINT) AS volume,
       avg(series.weighted_sentiment) AS mean_weighted_sentiment
FROM kept LEFT JOIN series ON series.week_end BETWEEN kept.start AND kept."end"
GROUP BY ALL
""")
def period_event_overlay(spark, sf_dir):
    series, _, periods = _calendar(spark, sf_dir)
    return ts.period_event_overlay(series, periods)
