"""Crawl progress state: low-water mark, backfill cursor and resume lookup.

The crawl log is a small table (one row per run).  Progress is derived from the stored posts —
``min(time)`` of what was actually written — so a crash between the insert and the log update
cannot skip posts (the reference saved progress before inserting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def low_water_mark(log: DataFrame, posts: DataFrame, run_col: str = "run_id",
                   time_col: str = "time", content_col: str = "content") -> DataFrame:
    """Per run, least(stored smallest_date, min(time) of its non-empty posts)."""
    seen = (posts.where(F.col(content_col).isNotNull() & (F.length(F.col(content_col)) > 0))
            .groupBy(run_col).agg(F.min(time_col).alias("_batch_min")))
    out = log.join(seen, run_col, "left")
    return out.withColumn("smallest_date", F.least(F.col("smallest_date"), F.col("_batch_min"))) \
              .drop("_batch_min")


def next_cursor(log: DataFrame, until: str | None = None, step_hours: int = 24) -> DataFrame:
    """At the end of a timeline, when ``timeline_start − smallest < 24 h`` step back one day;
    the new timeline start is that date; ``done`` when it falls below ``until``."""
    gap = F.col("timeline_start_date") - F.col("smallest_date")
    close = gap < F.expr(f"INTERVAL {step_hours} HOURS")
    nxt = F.when(close, F.col("smallest_date") - F.expr("INTERVAL 1 DAYS")).otherwise(F.col("smallest_date"))
    out = log.withColumn("next_timeline_start", nxt)
    done = (F.col("next_timeline_start") < F.lit(until).cast("timestamp_ntz")) if until else F.lit(False)
    return out.withColumn("done", done)


def resume_run(log: DataFrame, run_id: str | None = None) -> DataFrame:
    """The run to continue — the given run, or the latest by ``started_at``."""
    if run_id is not None:
        return log.where(F.col("run_id") == run_id)
    r = log.agg(F.max_by(F.struct(*log.columns), F.col("started_at")).alias("r"))
    return r.select("r.*")


def oldest_post_time(posts: DataFrame, time_col: str = "time") -> DataFrame:
    """E22 (v1): the time of the oldest stored post, where a fresh crawl continues backwards."""
    return posts.agg(F.min(time_col).alias("oldest_time"))
