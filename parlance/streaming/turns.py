"""Streams of transcript items and events: turns as they close, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN = "meeting_id string, turn_no long, speaker string, text string, n_items long, first_ts timestamp, last_ts timestamp"
_STATE = "turn_no long, speaker string, text string, n_items long, first_ts timestamp, last_ts timestamp"


def closed_turns(items: DataFrame, max_gap: str = "5 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Turns of a stream of items (meeting_id, ts, speaker, text), each given once it is over.

    A turn is over when another speaker is heard, after a pause of more than ``max_gap``, or when
    the watermark has passed it by that much. Items behind the watermark are dropped by Spark.
    """
    gap = pd.Timedelta(max_gap)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn_no, speaker, text, n, first, last = state.get if state.exists else (0, None, None, 0, None, None)
        out = []

        def close() -> None:
            out.append((key[0], turn_no, speaker, text, n, first, last))

        if state.hasTimedOut:
            if n:
                close()
            state.update((turn_no, None, None, 0, None, None))
        else:
            rows = pd.concat(list(parts))
            for ts, who, said in rows.sort_values("ts")[["ts", "speaker", "text"]].itertuples(index=False):
                if n and (who != speaker or ts - last > gap):
                    close()
                    n = 0
                if not n:
                    turn_no, speaker, text, first = turn_no + 1, who, said, ts
                else:
                    text = f"{text} {said}"
                n, last = n + 1, ts
            state.update((turn_no, speaker, text, n, first, last))
            state.setTimeoutTimestamp(max(int((last + gap).timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["meeting_id", "turn_no", "speaker", "text", "n_items", "first_ts", "last_ts"])

    marked = _timed(items.select(F.col("meeting_id").cast("string").alias("meeting_id"), "ts", "speaker", "text"), lateness)
    return marked.groupBy("meeting_id").applyInPandasWithState(run, TURN, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _timed(rows: DataFrame, lateness: str) -> DataFrame:
    """ts as an instant, which watermarks need; times without a zone are taken in the session's."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type over tumbling or sliding windows; works on streams and tables alike."""
    spans = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = _timed(events, lateness).groupBy(spans.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n_events", "total")


def sessions(events: DataFrame, gap: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of users by a gap, with Spark's own session windows."""
    agg = _timed(events, lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return agg.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
