"""Timestamp parsing, gap sessions and windows inside sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstseries.functions.ordered import gap_groups, join_on

DAY = 86_400

# The timestamp layouts met in the inputs.
EDGE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")
PING_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS")


def parse_timestamp(text: Column, formats: Sequence[str] = EDGE_FORMATS) -> Column:
    """The first layout that fits, else Spark's own reading; more than six fraction digits are cut."""
    trimmed = F.regexp_replace(text.cast("string"), r"(\.\d{6})\d+(Z|[+-]\d\d:\d\d)$", "$1$2")
    tries = [F.try_to_timestamp(trimmed, F.lit(f)) for f in formats]
    return F.coalesce(*tries, F.try_to_timestamp(trimmed))


def whole_second(ts: Column) -> Column:
    """Epoch seconds, fractions cut toward minus infinity."""
    return F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("long")


def second_sums(events: DataFrame, keys: Sequence[str], ts: str, value: Column) -> DataFrame:
    """One row per key and second: sessions depend on whole seconds only, so hot keys shrink here."""
    return (
        events.withColumns({"second": whole_second(F.col(ts)), "__v": F.coalesce(value, F.lit(0.0))})
        .groupBy(*keys, "second")
        .agg(F.sum("__v").alias("value_sum"), F.count(F.lit(1)).alias("n_rows"))
    )


def sessionize(seconds: DataFrame, keys: Sequence[str], gap: int = 300, chunk: int = DAY) -> DataFrame:
    """0-based session id per (key, second): a new session where more than ``gap`` seconds passed."""
    return gap_groups(seconds, keys, "second", gap=gap, width=chunk, out="session_id")


def label_events(events: DataFrame, keys: Sequence[str], ts: str, gap: int = 300, chunk: int = DAY) -> DataFrame:
    """The events themselves with their session id, joined on (key, second)."""
    stamped = events.withColumn("second", whole_second(F.col(ts)))
    ids = sessionize(stamped.select(*keys, "second").distinct(), keys, gap, chunk)
    return join_on(stamped, ids, [*keys, "second"])


def session_windows(sessions: DataFrame, keys: Sequence[str], window_seconds: int = 60) -> DataFrame:
    """Sums by session and tumbling window of the second-level rows."""
    start = F.floor(F.col("second") / F.lit(window_seconds)).cast("long") * F.lit(window_seconds)
    return (
        sessions.withColumn("window_start", F.timestamp_seconds(start))
        .groupBy(*keys, "session_id", "window_start")
        .agg(F.sum("value_sum").alias("sum_value"))
    )


def keep_long_sessions(windows: DataFrame, keys: Sequence[str], min_windows: int = 5) -> DataFrame:
    """The windows of sessions that have at least ``min_windows`` of them."""
    part = [*keys, "session_id"]
    enough = windows.groupBy(*part).agg(F.count(F.lit(1)).alias("num_windows")).filter(
        F.col("num_windows") >= min_windows
    )
    return join_on(windows, enough, part)
