"""Graphs and sessions from streams; the same functions take batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    """``(key, start, end, n)``: spans in which every event comes within ``gap`` of the one before.

    A span ends ``gap`` after its last event, as a session does that every access prolongs.  On a
    stream, ``late`` bounds how long spans stay open to late events.
    """
    if late:
        events = events.withWatermark(ts, late)
    spans = events.where(F.col(ts).isNotNull()).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return spans.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def expired(spans: DataFrame, now: str) -> DataFrame:
    """Spans that are over at ``now``."""
    return spans.where(F.col("end") <= F.lit(now).cast("timestamp"))


def latest(changes: DataFrame) -> DataFrame:
    """``(hid, version, deleted, tag, props)``: the last state of every row of a log of changes.

    ``changes(hid, version, deleted, tag, props)``; repeated and late changes do no harm.  One
    aggregation, so state is one row per handle; on a stream it runs in update mode.
    """
    state = F.struct("version", "deleted", "tag", F.to_json("props").alias("props"))
    last = changes.groupBy("hid").agg(F.max_by(state, F.col("version")).alias("s"))
    return last.select("hid", F.col("s.version").alias("version"), F.col("s.deleted").alias("deleted"), F.col("s.tag").alias("tag"), F.from_json("s.props", "map<string,string>").alias("props"))


def windowed(events: DataFrame, width: str, slide: str | None = None, ts: str = "ts", by: str = "event_type", late: str | None = None) -> DataFrame:
    """``(by, start, n)``: events by kind in tumbling or sliding windows."""
    if late:
        events = events.withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), "n")
