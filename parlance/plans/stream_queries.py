"""The streaming operators over the events table, read as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.plans.registry import query, table
from parlance.streaming import turns as st


@query("SELECT date_trunc('hour', ts)::VARCHAR AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the hour and type."""
    rows = st.windowed_counts(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_events", F.round("total", 4).alias("total"))


@query(
    """WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n_events FROM n GROUP BY user_id, s"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions by session windows."""
    rows = st.sessions(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")).alias("start_us"), "n_events")
