"""Per-series features as array expressions (no shuffle) and cleaning of wide feature tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstseries.functions.arrays import finite, keep_finite, let
from burstseries.functions.ordered import join_on
from burstseries.operators.order_stats import grouped_percentiles
from burstseries.session import cut_lineage

PREFIX = "value__"


# ---- series to features -------------------------------------------------------------------


def fixed_length(arr: Column, n: int = 600) -> Column:
    """Null arrays, null items and negatives as 0; padded with zeros or cut to ``n`` items."""
    zeros = F.array_repeat(F.lit(0.0), n)
    filled = F.when(arr.isNull(), zeros).otherwise(F.concat(arr.cast("array<double>"), zeros))
    return F.transform(F.slice(filled, 1, n), lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))


def _sum(arr: Column, f=lambda x: x) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + f(x))


def _share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0).cast("double"))


def _pairs(s: Column, lag: int, f) -> Column:
    """``f(x[t], x[t + lag])`` for every t; empty when the series is too short."""
    n = F.size(s)
    keep = F.greatest(n - lag, F.lit(0))
    return F.zip_with(F.slice(s, 1, keep), F.slice(s, F.lit(lag + 1), keep), f)


def _quantile(ordered: Column, n: Column, q: float) -> Column:
    at = F.lit(float(q)) * (n - 1)
    lo = F.floor(at).cast("int")
    a, b = F.get(ordered, lo), F.get(ordered, F.least(lo + 1, n.cast("int") - 1))
    return a + (b - a) * (at - lo)


def _longest_run(flags: Column) -> Column:
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(x, a["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.aggregate(flags, start, step)["best"]


def minimal_features(series: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Ten basic figures per series; an empty series gives nulls and length 0."""
    base = series.select(*keys, F.col(column).cast("array<double>").alias("__s"))
    s = F.col("__s")
    one = base.withColumns(
        {
            "__n": F.size(s).cast("double"),
            "__sum": _sum(s),
            "__sq": _sum(s, lambda x: x * x),
            "__sorted": F.array_sort(s),
        }
    )
    n = F.col("__n")
    two = one.withColumn("__mean", _share(F.col("__sum"), n))
    squares = let(F.col("__mean"), lambda m: F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
    three = two.withColumn("__var", _share(squares, n))
    out = {
        "sum_values": F.col("__sum"),
        "median": _quantile(F.col("__sorted"), n, 0.5),
        "mean": F.col("__mean"),
        "length": n,
        "standard_deviation": F.sqrt("__var"),
        "variance": F.col("__var"),
        "root_mean_square": F.sqrt(_share(F.col("__sq"), n)),
        "maximum": F.array_max(s),
        "absolute_maximum": F.array_max(F.transform(s, F.abs)),
        "minimum": F.array_min(s),
    }
    return three.select(*keys, *[c.alias(PREFIX + k) for k, c in out.items()])


def extended_features(
    series: DataFrame,
    keys: Sequence[str],
    column: str,
    lags: Sequence[int] = (1, 2, 3),
    sigmas: Sequence[float] = (1.0, 2.0),
    quantiles: Sequence[float] = (0.1, 0.9),
    entropy_bins: int = 10,
    peak_support: Sequence[int] = (1, 3),
) -> DataFrame:
    """Shape, change, order and distribution figures per series, in addition to the minimal ones.

    Works in layers, so that a figure used by many others (mean, deviations, differences) is
    computed once per row. Dots in parameter values are written as underscores in column names.
    """
    base = series.select(*keys, F.col(column).cast("array<double>").alias("__s"))
    s = F.col("__s")
    one = base.withColumns(
        {
            "__n": F.size(s).cast("double"),
            "__sum": _sum(s),
            "__sorted": F.array_sort(s),
            "__max": F.array_max(s),
            "__min": F.array_min(s),
            "__diff": _pairs(s, 1, lambda a, b: b - a),
            "__energy": _sum(s, lambda x: x * x),
        }
    )
    n, sum_, srt, hi, lo = (F.col(f"__{c}") for c in ("n", "sum", "sorted", "max", "min"))
    diff = F.col("__diff")
    two = one.withColumn("__mean", _share(sum_, n))
    mean = F.col("__mean")
    three = two.withColumn("__dev", let(mean, lambda m: F.transform(s, lambda x: x - m)))
    dev = F.col("__dev")
    four = three.withColumns(
        {
            "__m2": _sum(dev, lambda d: d * d),
            "__m3": _sum(dev, lambda d: d * d * d),
            "__m4": _sum(dev, lambda d: d * d * d * d),
        }
    )
    five = four.withColumn("__sd", F.sqrt(_share(F.col("__m2"), n)))
    sd, m2, m3, m4 = (F.col(f"__{c}") for c in ("sd", "m2", "m3", "m4"))
    var = _share(m2, n)
    sample_var = _share(m2, n - 1)
    span = F.size(diff).cast("double")

    out: dict[str, Column] = {
        "abs_energy": F.col("__energy"),
        "absolute_sum_of_changes": _sum(diff, F.abs),
        "mean_abs_change": _share(_sum(diff, F.abs), span),
        "mean_change": _share(F.get(s, F.size(s) - 1) - F.get(s, F.lit(0)), span),
        "cid_ce__normalize_False": F.sqrt(_sum(diff, lambda d: d * d)),
        "cid_ce__normalize_True": F.coalesce(_share(F.sqrt(_sum(diff, lambda d: d * d)), sd), F.lit(0.0)),
        "count_above_mean": _count(dev, lambda d: d > 0),
        "count_below_mean": _count(dev, lambda d: d < 0),
        "longest_strike_above_mean": _longest_run(F.transform(dev, lambda d: d > 0)).cast("double"),
        "longest_strike_below_mean": _longest_run(F.transform(dev, lambda d: d < 0)).cast("double"),
        "first_location_of_maximum": _share((F.array_position(s, hi) - 1).cast("double"), n),
        "first_location_of_minimum": _share((F.array_position(s, lo) - 1).cast("double"), n),
        "last_location_of_maximum": 1.0 - _share((F.array_position(F.reverse(s), hi) - 1).cast("double"), n),
        "last_location_of_minimum": 1.0 - _share((F.array_position(F.reverse(s), lo) - 1).cast("double"), n),
        "has_duplicate_max": let(hi, lambda v: (F.size(F.filter(s, lambda x: x == v)) >= 2).cast("double")),
        "has_duplicate_min": let(lo, lambda v: (F.size(F.filter(s, lambda x: x == v)) >= 2).cast("double")),
        "variance_larger_than_standard_deviation": (var > sd).cast("double"),
        "variation_coefficient": _share(sd, mean),
        "value_count__value_0": F.size(F.filter(s, lambda x: x == 0)).cast("double"),
        "share_of_zeros": _share(F.size(F.filter(s, lambda x: x == 0)).cast("double"), n),
        "ratio_value_number_to_time_series_length": _share(F.size(F.array_distinct(s)).cast("double"), n),
        "number_crossing_m__m_0": F.size(
            F.filter(_pairs(s, 1, lambda a, b: (a > 0) != (b > 0)), lambda x: x)
        ).cast("double"),
        "mean_second_derivative_central": _share(
            (F.get(s, F.size(s) - 1) - F.get(s, F.size(s) - 2) - F.get(s, F.lit(1)) + F.get(s, F.lit(0))) / 2.0,
            n - 2,
        ),
        "skewness": n * m3 / F.nullif((n - 1) * (n - 2) * F.pow(F.sqrt(sample_var), 3), F.lit(0.0)),
        "kurtosis": n * (n + 1) * m4 / F.nullif((n - 1) * (n - 2) * (n - 3) * sample_var * sample_var, F.lit(0.0))
        - 3 * (n - 1) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)),
    }
    for lag in lags:
        products = _pairs(dev, lag, lambda a, b: a * b)
        out[f"autocorrelation__lag_{lag}"] = _share(_share(_sum(products), n - lag), var)
        # x[t] * x[t+lag] paired with x[t+2 lag]
        keep = F.greatest(F.size(s) - 2 * lag, F.lit(0))
        third = F.slice(s, F.lit(2 * lag + 1), keep)
        firsts = F.slice(_pairs(s, lag, lambda a, b: a * b), F.lit(1), keep)
        out[f"c3__lag_{lag}"] = F.coalesce(
            _share(_sum(F.zip_with(firsts, third, lambda p, c: p * c)), n - 2 * lag), F.lit(0.0)
        )
        squares = F.zip_with(
            F.zip_with(F.slice(s, F.lit(lag + 1), keep), third, lambda b, c: F.struct(b.alias("b"), c.alias("c"))),
            F.slice(s, F.lit(1), keep),
            lambda bc, a: bc["c"] * bc["c"] * bc["b"] - bc["b"] * a * a,
        )
        out[f"time_reversal_asymmetry_statistic__lag_{lag}"] = F.coalesce(
            _share(_sum(squares), n - 2 * lag), F.lit(0.0)
        )
    for r in sigmas:
        name = f"{r:g}".replace(".", "_")
        out[f"ratio_beyond_r_sigma__r_{name}"] = _share(let(F.lit(float(r)) * sd, _beyond(dev)), n)
    for q in quantiles:
        out[f"quantile__q_{f'{q:g}'.replace('.', '_')}"] = _quantile(srt, n, q)
    for k in peak_support:
        out[f"number_peaks__n_{k}"] = F.size(
            F.filter(
                F.sequence(F.lit(k), F.greatest(F.size(s) - 1 - k, F.lit(k))),
                _is_peak(s, k),
            )
        ).cast("double")
    # straight line through (0, x0), (1, x1), ...
    xbar = (n - 1) / 2.0
    sxx = n * (n * n - 1) / 12.0
    sxy = let(xbar, lambda m: _sum(F.transform(dev, lambda d, i: d * (i - m))))
    out["linear_trend__attr_slope"] = _share(sxy, sxx)
    out["linear_trend__attr_intercept"] = mean - _share(sxy, sxx) * xbar
    out["linear_trend__attr_rvalue"] = sxy / F.nullif(F.sqrt(sxx * m2), F.lit(0.0))
    width = (hi - lo) / float(entropy_bins)
    frame = F.struct(lo.alias("lo"), F.nullif(width, F.lit(0.0)).alias("width"))
    cell = let(
        frame,
        lambda f: F.transform(
            s, lambda x: F.least(F.floor((x - f["lo"]) / f["width"]), F.lit(entropy_bins - 1)).cast("int")
        ),
    )

    def entropy(cells: Column) -> Column:
        every = F.sequence(F.lit(0), F.lit(entropy_bins - 1))
        shares = F.transform(every, lambda b: F.size(F.filter(cells, lambda c: c == b)) / F.size(cells))
        return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.ln(p)).otherwise(0.0))

    out[f"binned_entropy__max_bins_{entropy_bins}"] = F.when(hi > lo, let(cell, entropy)).otherwise(F.lit(0.0))
    return five.select(*keys, *[c.alias(PREFIX + k) for k, c in out.items()])


def _count(arr: Column, test) -> Column:
    return F.size(F.filter(arr, test)).cast("double")


def _beyond(dev: Column):
    return lambda bound: _count(dev, lambda d: F.abs(d) > bound)


def _is_peak(s: Column, support: int):
    return lambda i: F.coalesce(_all_lower(s, i, support) & (i + support < F.size(s)), F.lit(False))


def _all_lower(s: Column, i: Column, support: int) -> Column:
    """Item ``i`` is larger than its ``support`` neighbours on both sides."""
    test = F.lit(True)
    for d in range(1, support + 1):
        test = test & (F.get(s, i) > F.get(s, i - d)) & (F.get(s, i) > F.get(s, i + d))
    return test


def spectral_features(
    series: DataFrame, keys: Sequence[str], column: str, coefficients: int = 5, order: int = 2
) -> DataFrame:
    """Fourier coefficient sizes and least-squares autoregression weights, batch by batch in Arrow."""
    names = [f"{PREFIX}fft_coefficient__attr_abs__coeff_{k}" for k in range(coefficients)]
    names += [f"{PREFIX}ar_coefficient__coeff_{j}__k_{order}" for j in range(order + 1)]
    base = series.select(*keys, F.col(column).cast("array<double>").alias("__s"))
    key_fields = [base.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *[T.StructField(x, T.DoubleType()) for x in names]])

    def one(x: np.ndarray) -> list[float | None]:
        fft = np.abs(np.fft.rfft(x)) if len(x) else np.empty(0)
        row: list[float | None] = [float(fft[k]) if k < len(fft) else None for k in range(coefficients)]
        if len(x) > 2 * order + 1:
            design = np.column_stack([np.ones(len(x) - order), *[x[order - j - 1 : len(x) - j - 1] for j in range(order)]])
            row += [float(w) for w in np.linalg.lstsq(design, x[order:], rcond=None)[0]]
        else:
            row += [None] * (order + 1)
        return row

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [one(np.asarray(x if x is not None else [], dtype=float)) for x in frame["__s"]]
            got = pd.DataFrame(rows, columns=names, index=frame.index)
            yield pd.concat([frame[list(keys)], got], axis=1)

    return base.mapInPandas(batches, schema)


def simple_stats(series: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("inbound", "outbound")) -> DataFrame:
    """Eight plain figures per direction."""
    out = []
    for c in columns:
        s = F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>"))
        n = F.size(s).cast("double")
        mean = _share(_sum(s), n)
        mean_sq = _share(_sum(s, lambda x: x * x), n)
        figures = {
            "len": n,
            "sum": _sum(s),
            "mean": mean,
            "std": F.sqrt(F.greatest(F.lit(0.0), mean_sq - mean * mean)),
            "max": F.array_max(s),
            "nonzero": F.size(F.filter(s, lambda x: x != 0)).cast("double"),
            "first": F.get(s, F.lit(0)),
            "last": F.get(s, F.size(s) - 1),
        }
        out += [F.coalesce(v, F.lit(0.0)).alias(f"feat_{c}_{k}") for k, v in figures.items()]
    return series.select(*keys, *out)


def fano(arr: Column, sample: bool = False) -> Column:
    """Variance over mean of the finite items; null under two items or when the mean is not over 1e-12."""
    x = F.transform(keep_finite(arr), lambda v: v.cast("double"))

    def figure(f: Column) -> Column:
        n, mean = F.size(f["x"]), f["mean"]
        spread = F.aggregate(f["x"], F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        var = spread / F.nullif((n - (1 if sample else 0)).cast("double"), F.lit(0.0))
        return F.when((n >= 2) & (mean > 1e-12), var / mean)

    def with_mean(v: Column) -> Column:
        return F.struct(v.alias("x"), _share(_sum(v), F.size(v).cast("double")).alias("mean"))

    return let(let(x, with_mean), figure)


# ---- wide tables --------------------------------------------------------------------------


def feature_columns(df: DataFrame, prefix: str | None = PREFIX, exclude: Sequence[str] = ()) -> list[str]:
    """Columns with the prefix, or every numeric column when there are none (or no prefix)."""
    skip = set(exclude)
    named = [c for c in df.columns if prefix and c.startswith(prefix) and c not in skip]
    if named:
        return named
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed columns as double; what is no number becomes null."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in columns})


def present_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The listed columns that hold at least one number; one aggregate row of counts."""
    seen = [F.count(F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None).cast("double"))) for c in columns]
    got = df.agg(*[s.alias(f"n{i}") for i, s in enumerate(seen)]).first() if seen else []
    return [c for c, n in zip(columns, got, strict=True) if n]


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(ids, feature, value)`` rows; NaN becomes null."""
    doubles = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = doubles.unpivot([F.col(i) for i in ids], [F.col(f"`{c}`") for c in columns], "feature", "value")
    return long.withColumn("value", F.nanvl(F.col("value"), F.lit(None).cast("double")))


def column_stats(long: DataFrame) -> DataFrame:
    """Per feature: rows, present values, variance, share of zeros and whether it is constant."""
    v = F.col("value")
    out = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n"),
        F.var_pop(v).alias("var"),
        F.avg((v == 0).cast("double")).alias("frac_zero"),
    )
    return out.withColumn("is_constant", F.coalesce(F.isnan("var") | (F.col("var") <= 1e-12), F.lit(True)))


def _filled(c: str) -> Column:
    return F.coalesce(finite(F.col(f"`{c}`").try_cast("double")), F.lit(0.0))


def clean_minimal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers only: what is no finite number becomes 0, every row and column stays."""
    return df.withColumns({c: _filled(c) for c in columns})


def usable_columns(df: DataFrame, columns: Sequence[str], max_missing: float = 0.10) -> list[str]:
    """Columns that pass the strict rules, decided from one aggregate row per column.

    A column goes when all its values are missing, over ``max_missing`` of them are, or when it has
    no variance after missing and infinite values were set to 0.
    """
    raw = df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
    long = raw.unpivot([], [F.col(f"`{c}`") for c in columns], "feature", "value")
    missing = (F.col("value").isNull() | F.isnan("value")).cast("double")
    filled = F.coalesce(finite(F.col("value")), F.lit(0.0))
    facts = long.groupBy("feature").agg(
        F.avg(missing).alias("gone"), F.min(filled).alias("lo"), F.max(filled).alias("hi")
    )
    kept = facts.filter((F.col("gone") < 1.0) & (F.col("gone") <= max_missing) & (F.col("lo") < F.col("hi")))
    names = {r["feature"] for r in kept.select("feature").collect()}
    return [c for c in columns if c in names]


def clean_strict(df: DataFrame, ids: Sequence[str], columns: Sequence[str], max_missing: float = 0.10) -> DataFrame:
    """Ids and usable columns, missing and infinite values as 0, all-zero rows dropped."""
    keep = usable_columns(df, columns, max_missing)
    if not keep:
        raise ValueError("no feature columns are left")
    out = df.select(*ids, *[_filled(c).alias(c) for c in keep])
    any_value = F.exists(F.array(*[F.col(f"`{c}`") for c in keep]), lambda x: x != 0)
    return out.filter(any_value)


def impute_long(long: DataFrame) -> DataFrame:
    """Plus/minus infinity to the feature's largest/smallest finite value, missing to its median.

    Facts per feature are taken over the whole table, so the result does not depend on row chunks. The medians
    are selected by brackets, and the table of facts (a row per feature) is written, so that its size is known and
    the rows need no shuffle to meet it.
    """
    v = F.col("value")
    fin = finite(v)
    zero = F.lit(0.0)
    spans = long.groupBy("feature").agg(F.coalesce(F.max(fin), zero).alias("__hi"), F.coalesce(F.min(fin), zero).alias("__lo"))
    middle = grouped_percentiles(long.select("feature", fin.alias("value")), ["feature"], "value", [0.5])
    middle = middle.select("feature", F.coalesce(F.get("percentiles", F.lit(0)), zero).alias("__mid"))
    facts = cut_lineage(join_on(spans, middle, ["feature"]), "impute-facts")
    filled = (
        F.when(v.isNull() | F.isnan(v), F.col("__mid"))
        .when(v == float("inf"), F.col("__hi"))
        .when(v == float("-inf"), F.col("__lo"))
        .otherwise(v)
    )
    return join_on(long, facts, ["feature"]).withColumn("value", filled).drop("__hi", "__lo", "__mid")


def min_max_long(long: DataFrame) -> DataFrame:
    """Per feature its range over all rows, a flat one widened by 1, and values scaled into [0, 1]."""
    facts = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    facts = facts.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")))
    facts = cut_lineage(facts, "min-max-facts")  # of known size: the rows need no shuffle to meet it
    scaled = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12)
    return join_on(long, facts, ["feature"]).withColumn(
        "value_norm", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
    )
