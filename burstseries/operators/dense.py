"""Binned values to dense arrays or calendars, bins without data holding zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstseries.functions.arrays import head, let
from burstseries.functions.ordered import KEY, join_on, packed_key


def span_bounds(bins: DataFrame, keys: Sequence[str], max_len: int | None, bin_col: str = "bin") -> DataFrame:
    """First bin and (clamped) last bin per key."""
    lo, hi = F.min(bin_col), F.max(bin_col)
    last = hi if max_len is None else F.least(hi, lo + F.lit(max_len - 1))
    return bins.groupBy(*keys).agg(lo.alias("first_bin"), last.alias("last_bin"))


def dense_calendar(
    bins: DataFrame, keys: Sequence[str], values: Sequence[str], max_len: int | None = None, bin_col: str = "bin"
) -> DataFrame:
    """Every bin between a key's first and last one, absent values as 0."""
    bounds = span_bounds(bins, keys, max_len, bin_col)
    every = bounds.select(*keys, F.explode(F.sequence("first_bin", "last_bin")).alias(bin_col))
    joined = join_on(every, bins.select(*keys, bin_col, *values), [*keys, bin_col], "left")
    zero = {v: F.coalesce(F.col(v), F.lit(0).cast(bins.schema[v].dataType)) for v in values}
    return joined.withColumns(zero)


def dense_series(
    bins: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    *,
    threshold: float,
    min_len: int,
    max_len: int | None = None,
    truncate: str = "span",
    item_type: str = "float",
    bin_col: str = "bin",
) -> DataFrame:
    """One dense array per direction, from one row per (key, bin).

    Bins from the first observed one on, at most ``max_len`` of them if given; values below ``threshold``
    become 0. A key is kept when some direction has ``min_len`` positive items. ``truncate='span'``
    keeps the whole span, ``'kept'`` cuts each array to its own number of positive items.
    A group holds the observed bins of one key; a ``max_len`` cuts the span before they are gathered.
    """
    if truncate not in ("span", "kept"):
        raise ValueError("truncate is 'span' or 'kept'")
    known = bins.filter(F.col(bin_col).isNotNull()).withColumn(KEY, packed_key(keys))
    bounds = span_bounds(known, [KEY], max_len, bin_col)
    rows = known.select(KEY, F.col(bin_col).alias("__b"), *values.values())
    # the join and the gathering below share one partitioning by key
    near = rows.join(bounds, KEY).filter(F.col("__b") <= F.col("last_bin"))
    cell = F.struct(
        (F.col("__b") - F.col("first_bin")).alias("at"),
        *[
            F.when(F.col(src) >= threshold, F.col(src)).otherwise(F.lit(0)).cast(item_type).alias(out)
            for out, src in values.items()
        ],
    )
    cells = near.groupBy(KEY).agg(
        F.array_sort(F.collect_list(cell)).alias("__cells"),
        F.min("first_bin").alias("first_bin"),
        F.min("last_bin").alias("__last"),
        *[
            F.sum(((F.col(src) >= threshold) & (F.col(src) > 0)).cast("int")).cast("int").alias(f"__k_{out}")
            for out, src in values.items()
        ],
    )
    kept = [f"__k_{o}" for o in values]
    cells = cells.filter((F.greatest(*kept) if len(kept) > 1 else F.col(kept[0])) >= min_len)
    zero = F.lit(0).cast(item_type)

    def spread(out: str) -> Column:
        def whole(cells: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                before = F.when(i == 0, F.lit(-1).cast("long")).otherwise(F.get(cells, i - 1)["at"])
                gap = (c["at"] - before - 1).cast("int")
                return F.concat(F.array_repeat(zero, gap), F.array(c[out]))

            rest = F.col("__last") - F.col("first_bin") - F.element_at(cells, -1)["at"]
            return F.concat(F.flatten(F.transform(cells, one)), F.array_repeat(zero, rest.cast("int")))

        return let(F.col("__cells"), whole)

    out = cells.select(
        *[F.col(f"{KEY}.{k}").alias(k) for k in keys], "first_bin", *[spread(o).alias(o) for o in values], *kept
    )
    if truncate == "kept":
        out = out.withColumns({o: head(o, F.col(f"__k_{o}")) for o in values})
    return out.drop(*kept)


def one_direction(series: DataFrame, copy: bool = False) -> DataFrame:
    """Add an ``outbound`` array to a one-direction series: zeros, or a copy of ``inbound``."""
    same = F.col("inbound")
    return series.withColumn("outbound", same if copy else F.transform(same, lambda x: x * 0))


def whole_chunks(series: DataFrame, arrays: Sequence[str], seq_len: int, length: Column) -> DataFrame:
    """Cut arrays to consecutive chunks of exactly ``seq_len`` items; a shorter tail is dropped."""
    n = F.floor(length / F.lit(seq_len)).cast("int")
    full = series.filter(n > 0)
    each = full.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("chunk_idx") * seq_len + 1
    return each.withColumns({a: F.slice(F.col(a), start, F.lit(seq_len)) for a in arrays})


def mean_bins(samples: DataFrame, keys: Sequence[str], second: str, value: str, bin_sec: int) -> DataFrame:
    """Mean value per key and time bin."""
    at = F.floor(F.col(second) / F.lit(bin_sec)).cast("long")
    return samples.withColumn("bin", at).groupBy(*keys, "bin").agg(F.avg(value).alias("mean_value"))


def mean_series_chunks(
    bins: DataFrame,
    keys: Sequence[str],
    *,
    threshold: float,
    min_len: int,
    seq_len: int,
    max_len: int | None = None,
    store_bins: bool = False,
) -> DataFrame:
    """Dense mean-value arrays cut to whole chunks, each with its first bin and an example id."""
    whole = dense_series(
        bins, keys, {"inbound": "mean_value"}, threshold=threshold, max_len=max_len, min_len=min_len
    )
    chunks = whole_chunks(whole, ["inbound"], seq_len, F.size("inbound"))
    first = F.col("first_bin") + F.col("chunk_idx").cast("long") * seq_len
    out = chunks.withColumns(
        {
            "first_bin": first,
            "example_id": F.concat_ws("_", *[F.col(k).cast("string") for k in (*keys, "chunk_idx")]),
        }
    )
    if store_bins:
        out = out.withColumn("bins", F.sequence(F.col("first_bin"), F.col("first_bin") + F.size("inbound") - 1))
    return out
