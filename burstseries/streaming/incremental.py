"""The batch operators of flows, sessions and bursts in incremental form."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from burstseries.functions.ordered import join_on
from burstseries.session import fresh_path


def tumbling_sums(events: DataFrame, keys: Sequence[str], ts: str, value: str, window: str, delay: str) -> DataFrame:
    """Sums per key and tumbling window; late rows beyond ``delay`` are dropped by the watermark."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, window).alias("w"))
        .agg(F.sum(value).alias("sum_value"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("window_start"), "sum_value", "n")
    )


def gap_sessions(events: DataFrame, keys: Sequence[str], ts: str, value: str, gap_seconds: int, delay: str) -> DataFrame:
    """One row per closed session; an event exactly at the gap still belongs to it.

    Sessions are measured in whole seconds, as in the batch form.
    """
    second = F.timestamp_seconds(F.floor(F.unix_micros(F.col(ts)) / F.lit(1_000_000)).cast("long"))
    return (
        events.withColumn("__s", second)
        .withWatermark("__s", delay)
        .groupBy(*keys, F.session_window("__s", f"{gap_seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("sum_value"))
        .select(
            *keys,
            F.col("w.start").alias("session_start"),
            (F.col("w.end") - F.expr(f"make_dt_interval(0, 0, 0, {gap_seconds})")).alias("session_last"),
            "n_events",
            "sum_value",
        )
    )


class _LastBurst(StatefulProcessor):
    """Per key the last active bin, and a timer that forgets it after ``idle_seconds`` without one."""

    def __init__(self, names: Sequence[str], bin_seconds: int, threshold: float, idle_seconds: int | None):
        self.names, self.bin_seconds, self.threshold, self.idle = list(names), bin_seconds, threshold, idle_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "bin long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        before, out = last, []
        sums = pd.concat(list(rows)).sort_values("bin")
        for b, v in zip(sums["bin"].tolist(), sums["value"].tolist(), strict=True):
            if v is not None and v >= self.threshold:
                out.append((*key, b, v, 0 if last is None else b - last))
                last = b
        if last != before:
            self.last.update((last,))
            if self.idle is not None:
                self.handle.registerTimer((last + 1) * self.bin_seconds * 1000 + self.idle * 1000)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers of earlier bursts are still set: only that of the last one clears
        mine = None if not self.last.exists() else ((self.last.get()[0] + 1) * self.bin_seconds + self.idle) * 1000
        if mine is not None and mine <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame([], columns=self.names)

    def close(self) -> None:
        pass


def bin_sums(events: DataFrame, keys: Sequence[str], ts: str, value: str, bin_seconds: int, delay: str) -> DataFrame:
    """``(key, bin, value)`` once the watermark has passed a bin's end; partial sums, no Python."""
    windows = events.withWatermark(ts, delay).groupBy(*keys, F.window(ts, f"{bin_seconds} seconds").alias("w"))
    sums = windows.agg(F.sum(F.col(value).cast("double")).alias("value"))
    return sums.select(*keys, _bin_of("w.start", bin_seconds).alias("bin"), "value")


def _bin_of(start: str, bin_seconds: int) -> Column:
    return F.floor(F.unix_seconds(start) / F.lit(bin_seconds)).cast("long")


def burst_stream(
    events: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    bin_seconds: int,
    threshold: float,
    delay: str,
    idle_seconds: int | None = None,
) -> DataFrame:
    """Burst rows ``(key, bin, bi, ibg)`` as bins close.

    Only bin sums, one row per key and bin, reach the stateful step, whose state is one number per key. With
    ``idle_seconds`` a key without a burst for so long is forgotten, and its next burst has no gap; without, gaps
    are those of the batch form however long they are. Needs the RocksDB state store (``run`` sets it).
    """
    sums = bin_sums(events, keys, ts, value, bin_seconds, delay)
    fields = [sums.schema[k] for k in keys]
    out = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("bin", T.LongType()), ("bi", T.DoubleType()), ("ibg", T.LongType())))])
    step = _LastBurst(out.names, bin_seconds, threshold, idle_seconds)
    return sums.groupBy(*keys).transformWithStateInPandas(step, out, "Append", "EventTime")


# ---- running over what is there, with a closing pass over open state ------------------------

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame, spark: SparkSession, name: str) -> str:
    """Run a stream over what is there now; the folder with its rows (``data``) and state (``state``)."""
    path = fresh_path(spark, name)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{path}/data")
            .option("checkpointLocation", f"{path}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return path


def closed_rows(stream: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """What the watermark has closed."""
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def open_rows(spark: SparkSession, path: str, operator: int = 0, variable: str | None = None) -> DataFrame:
    """``(key, value)``: what a stateful step of a finished run still holds, read from its state store."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    if variable:
        reader = reader.option("stateVarName", variable)
    return reader.load(f"{path}/state")


def all_tumbling_sums(events: DataFrame, keys: Sequence[str], ts: str, value: str, window: str, delay: str) -> DataFrame:
    """``tumbling_sums`` over what is there now, open windows included: the rows of the batch form."""
    spark, stream = events.sparkSession, tumbling_sums(events, keys, ts, value, window, delay)
    path = run(stream, spark, "stream-windows")
    held = [F.col(f"key.{k}").alias(k) for k in keys]
    rest = open_rows(spark, path).select(*held, F.col("key.window.start").alias("window_start"), F.col("value.sum").alias("sum_value"), F.col("value.count").alias("n"))
    return closed_rows(stream, spark, path).unionByName(rest)


def all_gap_sessions(events: DataFrame, keys: Sequence[str], ts: str, value: str, gap_seconds: int, delay: str) -> DataFrame:
    """``gap_sessions`` over what is there now, open sessions included: the rows of the batch form."""
    spark, stream = events.sparkSession, gap_sessions(events, keys, ts, value, gap_seconds, delay)
    path = run(stream, spark, "stream-sessions")
    v = F.col("value")
    rest = open_rows(spark, path).select(
        *[F.col(f"key.{k}").alias(k) for k in keys],
        v["session_window"]["start"].alias("session_start"),
        (v["session_window"]["end"] - F.expr(f"make_dt_interval(0, 0, 0, {gap_seconds})")).alias("session_last"),
        v["count"].alias("n_events"),
        v["sum"].alias("sum_value"),
    )
    return closed_rows(stream, spark, path).unionByName(rest)


def all_bursts(events: DataFrame, keys: Sequence[str], ts: str, value: str, bin_seconds: int, threshold: float, delay: str) -> DataFrame:
    """``burst_stream`` over what is there now, open bins included: the rows of the batch form.

    A key has as many open bins as the watermark's delay holds, so the window over them is bounded.
    """
    spark, stream = events.sparkSession, burst_stream(events, keys, ts, value, bin_seconds, threshold, delay)
    path = run(stream, spark, "stream-bursts")
    held = [F.col(f"key.{k}").alias(k) for k in keys]
    bins = open_rows(spark, path, 1).select(*held, _bin_of("key.window.start", bin_seconds).alias("bin"), F.col("value.sum").alias("bi"))
    last = open_rows(spark, path, 0, "last").select(*held, F.col("value.bin").alias("last"))
    mine = join_on(bins.filter(F.col("bi") >= threshold), last, list(keys), "left")
    previous = F.lag("bin").over(Window.partitionBy(*keys).orderBy("bin"))
    rest = mine.withColumn("ibg", F.coalesce(F.col("bin") - F.coalesce(previous, F.col("last")), F.lit(0).cast("long"))).drop("last")
    return closed_rows(stream, spark, path).unionByName(rest.select(*stream.columns))
