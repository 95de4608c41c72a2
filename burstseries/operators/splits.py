"""Reproducible train/test and context/forecast splits, mirrored onto the dense series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstseries.functions.arrays import count_where, head, item_rows, total_long
from burstseries.functions.hashing import hash_hex, unit_hash
from burstseries.functions.ordered import global_row_number, join_on, with_row


def length_filter(bursts: DataFrame, *, min_bursts: int, min_len: int | None = None, max_len: int | None = None):
    """Series with enough positive bursts and items, cut to the first ``max_len``."""
    out = bursts.withColumn("_burst_count", count_where("bi", lambda x: x > 0)).filter(
        F.col("_burst_count") >= min_bursts
    )
    if min_len is not None:
        out = out.filter(F.size("bi") >= min_len)
    if max_len is not None:
        arrays = [a for a in ("bi", "ibg", "active_bins") if a in out.columns]
        out = out.withColumns({a: head(a, max_len) for a in arrays})
    return out.withColumn("_seq_len", F.size("bi"))


def context_forecast(bursts: DataFrame, ratio: float, unit: int = 1) -> DataFrame:
    """Lengths of context and forecast and the bins where they end and start (null when empty).

    The bins come from two bounded sums over the gaps (or from ``active_bins``), so nothing is
    exploded or shuffled.
    """
    ctx = (F.col("_seq_len") * F.lit(float(ratio))).cast("int")
    out = bursts.withColumn("context_len", ctx).withColumn("forecast_len", F.col("_seq_len") - F.col("context_len"))
    c, f = F.col("context_len"), F.col("forecast_len")
    if "active_bins" in bursts.columns:

        def bin_at(n: Column) -> Column:
            return F.get(F.col("active_bins"), n - 1)

    else:
        steps = F.col("ibg") if unit == 1 else F.transform("ibg", lambda x: F.floor(x / F.lit(unit)).cast("long"))

        def bin_at(n: Column) -> Column:
            return F.col("first_bin") + total_long(head(steps, n))

    return out.withColumns(
        {
            "context_end_bin": F.when(c > 0, bin_at(c)),
            "forecast_start_bin": F.when(f > 0, bin_at(c + 1)),
            "forecast_end_bin": F.when(f > 0, bin_at(c + f)),
        }
    )


def assign_split(
    df: DataFrame, keys: Sequence[str], ratio: float, seed: int = 42, names: tuple[str, str] = ("train", "test")
) -> DataFrame:
    """A stable hash of the key picks the side, whatever the partitioning."""
    return df.withColumn(
        "split", F.when(unit_hash(keys, seed) < F.lit(float(ratio)), names[0]).otherwise(names[1])
    )


def split_slices(df: DataFrame) -> DataFrame:
    """Context and forecast parts of both burst arrays."""
    c, f = F.col("context_len"), F.col("forecast_len")
    parts = {}
    for a in ("bi", "ibg"):
        parts[f"context_{a}"] = head(a, c)
        parts[f"forecast_{a}"] = F.slice(F.col(a), c + 1, f)
    return df.withColumns(parts)


def make_splits(
    bursts: DataFrame,
    keys: Sequence[str],
    *,
    train_ratio: float = 0.7,
    context_ratio: float = 0.7,
    min_bursts: int = 3,
    min_len: int | None = 3,
    max_len: int | None = None,
    seed: int = 42,
    unit: int = 1,
) -> DataFrame:
    """Filter, geometry, split side, example id and slices in one narrow chain."""
    kept = length_filter(bursts, min_bursts=min_bursts, min_len=min_len, max_len=max_len)
    shaped = context_forecast(kept, context_ratio, unit)
    sided = assign_split(shaped, keys, train_ratio, seed)
    named = sided.withColumn("example_id", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    return split_slices(named)


META = (
    "first_bin",
    "_burst_count",
    "_seq_len",
    "context_len",
    "forecast_len",
    "context_end_bin",
    "forecast_start_bin",
    "forecast_end_bin",
    "split",
)


def splits_meta(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return splits.select("example_id", *keys, *META)


def mirror_series(
    series: DataFrame,
    meta: DataFrame,
    keys: Sequence[str],
    *,
    mode: str = "burst_timestamp",
    threshold: float = 0.0,
    burst_column: str = "inbound",
) -> DataFrame:
    """Cut the dense series where the burst split says: by burst time, or (legacy) by burst counts."""
    need = ["split", "context_len", "forecast_len"]
    if mode == "burst_timestamp":
        need += ["forecast_start_bin", "forecast_end_bin"]
    elif mode != "legacy_index":
        raise ValueError("mode is 'burst_timestamp' or 'legacy_index'")
    joined = join_on(series, meta.select(*keys, *need), keys)
    n = F.size(burst_column)
    directions = [d for d in ("inbound", "outbound") if d in series.columns]
    if mode == "burst_timestamp":
        start, end = F.col("forecast_start_bin"), F.col("forecast_end_bin")
        lengths = {
            "sparse_context_len": F.least(n, start).cast("int"),
            "sparse_forecast_len": F.when(end.isNull(), F.lit(0))
            .otherwise(F.greatest(F.lit(0), F.least(n - start, end - start + 1)))
            .cast("int"),
        }
        begin = (start + 1).cast("int")
    else:
        lengths = {"sparse_context_len": F.col("context_len"), "sparse_forecast_len": F.col("forecast_len")}
        begin = F.col("context_len") + 1
    joined = joined.withColumns(lengths)
    parts = {}
    for d in directions:
        parts[f"context_{d}"] = head(d, F.col("sparse_context_len"))
        parts[f"forecast_{d}"] = F.slice(F.col(d), begin, F.col("sparse_forecast_len"))
    out = joined.withColumns(parts)
    if mode == "burst_timestamp":
        over = count_where(f"forecast_{burst_column}", lambda x: x >= threshold)
        out = out.withColumn("sparse_forecast_burst_count", over)
    return out


def burst_parity(mirrored: DataFrame, split: str = "test", strict: bool = False) -> DataFrame:
    """How many series of a split side hold another number of bursts than their forecast length."""
    off = (F.col("sparse_forecast_burst_count") != F.col("forecast_len")).cast("long")
    out = mirrored.filter(F.col("split") == split).agg(
        F.coalesce(F.sum(off), F.lit(0).cast("long")).alias("mismatches"), F.count(F.lit(1)).alias("total")
    )
    if strict:
        failed = F.raise_error(F.lit("burst counts differ between series and splits")).cast("long")
        out = out.withColumn("mismatches", F.when(F.col("mismatches") > 0, failed).otherwise(F.col("mismatches")))
    return out


def training_windows(bursts: DataFrame, arrays: Sequence[str], max_len: int, min_len: int) -> DataFrame:
    """Consecutive windows of ``max_len`` items; the last may be shorter but not under ``min_len``.

    A series that fits into one window is kept as it is.
    """
    n = F.size(arrays[0])
    each = bursts.filter(n > 0).select(
        "*", F.explode(F.sequence(F.lit(0), n - 1, F.lit(max_len))).alias("window_start"), (n <= max_len).alias("__all")
    )
    cut = each.withColumns({a: F.slice(F.col(a), F.col("window_start") + 1, F.lit(max_len)) for a in arrays})
    return cut.filter(F.col("__all") | (F.size(arrays[0]) >= min_len)).drop("__all")


def shuffle_cut(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Seeded global shuffle order and an exact cut: the first int(n * fraction) rows are ``train``."""
    numbered = global_row_number(df.withColumn("__h", hash_hex(keys, seed)), "__h", keys, "__rn")
    size = df.agg(F.count(F.lit(1)).alias("__n"))
    cut = (F.col("__n") * F.lit(float(fraction))).cast("long")
    out = with_row(numbered, size)
    return out.withColumn("split", F.when(F.col("__rn") <= cut, "train").otherwise("val")).drop("__h", "__rn", "__n")


def horizon_split(length: Column, *, min_ctx: int, min_h: int = 1, fraction: float = 0.7, longest: bool = False):
    """``(context, horizon)`` columns, null where the series is too short to be split.

    ``longest`` leaves just the least horizon; else the context is the rounded-up fraction, and at
    most ``min_ctx`` items are given back when the horizon would be under ``min_h``.
    """
    mh = max(1, int(min_h))
    n = length.cast("int")
    if longest:
        ctx = F.greatest(F.lit(min_ctx), n - mh)
    else:
        part = F.greatest(F.lit(min_ctx), F.ceil(F.lit(float(fraction)) * n).cast("int"))
        back = F.least(F.lit(min_ctx), F.lit(mh) - (n - part))
        ctx = F.when(n - part < mh, F.greatest(F.lit(min_ctx), part - back)).otherwise(part)
        ctx = F.when((n - ctx <= 0) & (n > min_ctx), n - 1).otherwise(ctx)
    usable = (n >= min_ctx + mh) & (n - ctx > 0)
    return F.when(usable, ctx).cast("int"), F.when(usable, n - ctx).cast("int")


def positive_only(series: DataFrame, columns: Sequence[str], min_len: int, max_len: int | None = None) -> DataFrame:
    """Only items over 0 (pads and zeros go), series of at least ``min_len``, cut to ``max_len``."""
    out = series.withColumns({c: F.filter(F.col(c), lambda x: x > 0) for c in columns})
    for c in columns:
        out = out.filter(F.size(c) >= min_len)
    return out if max_len is None else out.withColumns({c: head(c, max_len) for c in columns})


def burst_loader(
    bursts: DataFrame, min_len: int, max_len: int | None = None, limit: int | None = None
) -> DataFrame:
    """Burst pairs fit for training: null arrays are empty, both long enough and equally long.

    ``limit`` is the loader's own option for trial runs.
    """
    fill = {a: F.coalesce(F.col(a), F.array().cast(bursts.schema[a].dataType)) for a in ("bi", "ibg")}
    out = bursts.withColumns(fill).filter(
        (F.size("bi") >= min_len) & (F.size("ibg") >= min_len) & (F.size("bi") == F.size("ibg"))
    )
    if max_len is not None:
        out = out.withColumns({a: head(a, max_len) for a in ("bi", "ibg")})
    return out if limit is None else out.limit(limit)


def split_loader(splits: DataFrame, min_len: int) -> DataFrame:
    """Split rows fit for forecasting: both parts present, both streams equally long in total."""
    c_bi, f_bi = F.size("context_bi"), F.size("forecast_bi")
    c_ib, f_ib = F.size("context_ibg"), F.size("forecast_ibg")
    return splits.filter(
        (c_bi >= 1) & (f_bi >= 1) & (c_bi + f_bi >= max(2, min_len)) & (c_bi + f_bi == c_ib + f_ib)
    )


def nested_loader(df: DataFrame, keys: Sequence[str], column: str, min_len: int, max_len: int | None = None):
    """Legacy nested arrays: inner arrays led by 0 are kept, the lead dropped, pads and zeros stripped."""
    each = item_rows(df, keys, column, "part", "__a")
    kept = each.filter(F.get("__a", F.lit(0)) == 0)
    values = F.filter(F.slice("__a", 2, F.greatest(F.size("__a") - 1, F.lit(0))), lambda x: (x != -1) & (x != 0))
    out = kept.select(*keys, "part", values.alias("series")).filter(F.size("series") >= min_len)
    return out if max_len is None else out.withColumn("series", head("series", max_len))


def series_long(series: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``(key, time_index, value)`` rows of an array column."""
    return item_rows(series, keys, column, "time_index", "value")


def aligned_long(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Both series of a pair side by side per index; the shorter one is null at its end."""
    zipped = F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))
    return item_rows(pairs, keys, zipped, "time_index", "__z").select(
        *keys, "time_index", F.col("__z.l").alias("left_value"), F.col("__z.r").alias("right_value")
    )
