"""Distances between two series of one row: transport cost and dynamic time warping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstseries.functions.arrays import head, let
from burstseries.operators.retrieval import PAD_ID


def _w1(a: Column, b: Column) -> Column:
    """Transport cost between two weight arrays over positions 0, 1, ...: one walk over both."""
    zero = F.lit(0.0)

    def walk(w: Column) -> Column:
        sa = F.aggregate(w["a"], zero, lambda s, x: s + x)
        sb = F.aggregate(w["b"], zero, lambda s, x: s + x)
        both = F.zip_with(w["a"], w["b"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        # the totals ride along in the state, so they are summed once
        start = F.struct(
            zero.alias("x"), zero.alias("y"), zero.alias("t"), zero.alias("last"), sa.alias("sa"), sb.alias("sb")
        )
        # the gap after the last position spans no distance
        return F.aggregate(both, start, step, lambda s: s["t"] - s["last"])

    def step(s: Column, v: Column) -> Column:
        x, y = s["x"] + v["x"], s["y"] + v["y"]
        gap = F.abs(x / s["sa"] - y / s["sb"])
        return F.struct(
            x.alias("x"),
            y.alias("y"),
            (s["t"] + gap).alias("t"),
            gap.alias("last"),
            s["sa"].alias("sa"),
            s["sb"].alias("sb"),
        )

    return let(F.struct(a.alias("a"), b.alias("b")), walk)


def common_length(a: Column, b: Column) -> Column:
    return F.least(F.size(a), F.size(b))


def _doubles(arr: Column) -> Column:
    return F.transform(arr, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))


def _mask(a: Column, b: Column) -> tuple[Column, Column]:
    """Both series set to 0 where the first is not positive."""
    zero = F.lit(0.0)
    left = F.transform(a, lambda x: F.when(x <= 0, zero).otherwise(x))
    right = F.zip_with(a, b, lambda x, y: F.when(x <= 0, zero).otherwise(y))
    return left, right


def time_wasserstein(a: Column, b: Column, eps: float = 1e-20) -> Column:
    """Mass-on-time distance over the common length; positions without mass in ``a`` carry only ``eps``."""
    n = common_length(a, b)
    left, right = _mask(_doubles(head(a, n)), _doubles(head(b, n)))
    w = _w1(F.transform(left, lambda x: x + eps), F.transform(right, lambda x: x + eps))
    return F.when(n > 0, w)


def tail_wasserstein(truth: Column, pred: Column, threshold: float = 0.0, eps: float = 1e-2) -> Column:
    """Mass-on-time distance of a forecast, zero-padded or cut to the truth's length.

    Positions where the truth is not over ``threshold`` carry only ``eps``; negative forecasts count as 0.
    """

    def cost(s: Column) -> Column:
        gt, pr = s["t"], s["p"]
        left = F.transform(gt, lambda x: F.when(x <= threshold, F.lit(0.0)).otherwise(x.cast("double")) + eps)
        right = F.transform(
            gt,
            lambda x, i: F.when(x <= threshold, F.lit(0.0)).otherwise(
                F.greatest(F.coalesce(F.get(pr, i).cast("double"), F.lit(0.0)), F.lit(0.0))
            )
            + eps,
        )
        return F.when(F.size(gt) > 0, _w1(left, right))

    return let(F.struct(truth.alias("t"), pred.alias("p")), cost)


def value_wasserstein(a: Column, b: Column) -> Column:
    """Distance of the value distributions over the common length: mean gap of the sorted items."""
    n = common_length(a, b)
    pairs = F.zip_with(
        F.array_sort(_doubles(head(a, n))), F.array_sort(_doubles(head(b, n))), lambda x, y: F.abs(x - y)
    )
    return F.when(n > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n)


def z_scaled(arr: Column) -> Column:
    """Mean 0 and deviation 1; a series without spread becomes zeros."""
    n = F.nullif(F.size(arr).cast("double"), F.lit(0.0))

    def shifted(mean: Column) -> Column:
        return F.transform(arr, lambda x: x - mean)

    def scaled(d: Column) -> Column:
        dev = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x) / n)
        return let(dev, lambda s: F.transform(d, lambda x: F.when(s < 1e-12, F.lit(0.0)).otherwise(x / s)))

    return let(let(F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / n, shifted), scaled)


def warp_inputs(a: Column, b: Column, mode: str = "normalized") -> tuple[Column, Column]:
    """The two series as the warping distance takes them: masked and z-scaled, or in millions."""
    n = common_length(a, b)
    left, right = _doubles(head(a, n)), _doubles(head(b, n))
    if mode == "normalized":
        left, right = _mask(left, right)
        return z_scaled(left), z_scaled(right)
    if mode != "unnormalized":
        raise ValueError("mode is 'normalized' or 'unnormalized'")

    def million(x: Column) -> Column:
        return F.greatest(x / 1e6, F.lit(0.0))

    return F.transform(left, million), F.transform(right, million)


def warp_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping with absolute cost, one anti-diagonal of the cost table at a time."""
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return float("nan")
    before = np.full(n + 1, np.inf)
    last = np.full(n + 1, np.inf)
    before[0] = 0.0
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        now = np.full(n + 1, np.inf)
        now[lo : hi + 1] = np.abs(a[i - 1] - b[d - i - 1]) + np.minimum(
            np.minimum(last[lo - 1 : hi], last[lo : hi + 1]), before[lo - 1 : hi]
        )
        before, last = last, now
    return float(last[n])


WARPED = {"dtw_distance_normalized": ("__na", "__nb"), "dtw_distance_unnormalized": ("__ra", "__rb")}


def _warp_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for name, (a, b) in WARPED.items():
            frame[name] = [
                None if x is None or y is None else warp_distance(np.asarray(x, dtype=float), np.asarray(y, dtype=float))
                for x, y in zip(frame[a], frame[b], strict=True)
            ]
            frame[name] = frame[name].astype("Float64")
        yield frame.drop(columns=[c for pair in WARPED.values() for c in pair])


def pair_distances(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The four distances of each row's two series in place of the series; null where one is missing.

    Only the prepared series travel to Python, where the quadratic warping table is walked.
    """
    a, b = F.col(left), F.col(right)
    norm, raw = warp_inputs(a, b, "normalized"), warp_inputs(a, b, "unnormalized")
    there = a.isNotNull() & b.isNotNull() & (common_length(a, b) > 0)
    keep = [c for c in pairs.columns if c not in (left, right)]
    ready = pairs.select(
        *keep,
        F.when(there, time_wasserstein(a, b)).alias("wasserstein_distance_normalized"),
        F.when(there, value_wasserstein(a, b)).alias("wasserstein_distance_unnormalized"),
        F.when(there, norm[0]).alias("__na"),
        F.when(there, norm[1]).alias("__nb"),
        F.when(there, raw[0]).alias("__ra"),
        F.when(there, raw[1]).alias("__rb"),
    )
    hidden = {c for pair in WARPED.values() for c in pair}
    fields = [f for f in ready.schema if f.name not in hidden]
    fields += [T.StructField(n, T.DoubleType()) for n in WARPED]
    return ready.mapInPandas(_warp_batches, T.StructType(fields))


def distance_rows(neighbors: DataFrame, series: DataFrame, *, series_key: str = "point_id", column: str = "series"):
    """Distances of every (query, neighbour slot) row.

    ``neighbors`` has ``test_point_id, neighbor_id, cluster_id, rank, neighbor_count`` (null neighbour =
    padded slot); series are joined by point id on both sides.
    """
    side = series.select(F.col(series_key).alias("__k"), F.col(column).alias("__s"))
    left = side.withColumnsRenamed({"__k": "test_point_id", "__s": "__eval"})
    right = side.withColumnsRenamed({"__k": "neighbor_id", "__s": "__near"})
    joined = neighbors.join(left, "test_point_id", "left").join(right, "neighbor_id", "left")
    flagged = joined.withColumns(
        {"eval_found": F.col("__eval").isNotNull(), "neighbor_found": F.col("__near").isNotNull()}
    )
    # the quadratic work is spread by pair, as a popular neighbour would else sit in one task
    got = pair_distances(flagged.repartition("test_point_id", "rank"), "__eval", "__near")
    return got.select(
        "test_point_id",
        F.coalesce("neighbor_id", F.lit(PAD_ID)).alias("neighbor_id"),
        "cluster_id",
        "rank",
        F.col("wasserstein_distance_normalized").alias("wasserstein_distance"),
        "wasserstein_distance_normalized",
        "wasserstein_distance_unnormalized",
        "dtw_distance_normalized",
        "dtw_distance_unnormalized",
        "neighbor_count",
        "eval_found",
        "neighbor_found",
    )
