"""Ordered scans (previous value, running total, dense row number) that split hot keys.

A plain window puts all rows of a key into one task. Here a key's rows are cut into chunks of
the ordering column; each chunk is scanned on its own, one summary row per chunk is scanned per
key, and the summaries are joined back on (key, chunk). Callers first aggregate to one row per
(key, order value), so a chunk holds at most ``width`` rows whatever the key's share of the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
KEY = "__key"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        test = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = test if cond is None else cond & test
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def packed_key(keys: Sequence[str]) -> Column:
    """The keys as one struct: never null itself and equal also where fields are null.

    Grouping, windows and plain equi-joins on it share one partitioning. A null-safe comparison of
    the single keys would make Spark shuffle the large side once more for the join.
    """
    return F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def with_chunk(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Pack the keys and add the chunk number; rows without an order value share a chunk of their own."""
    return df.withColumns(
        {KEY: packed_key(keys), CHUNK: F.coalesce(chunk.cast("long"), F.lit(-(2**62)).cast("long"))}
    )


def chunked_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    width: int | None = None,
    chunk: Column | None = None,
    lags: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add, per key in ``order``, the previous value (``lags``) and inclusive running total (``sums``).

    Both map an output column to its input column; one row per key and order value. Chunks are
    ``width`` wide, or given by ``chunk``, any expression that does not fall as ``order`` grows.
    """
    lags, sums = dict(lags or {}), dict(sums or {})
    df = with_chunk(df, keys, F.floor(F.col(order) / F.lit(width)) if chunk is None else chunk)
    part = [KEY, CHUNK]
    local = Window.partitionBy(*part).orderBy(order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_key = Window.partitionBy(KEY).orderBy(CHUNK)
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)

    edges = df.groupBy(*part).agg(
        *[F.max_by(c, order).alias(f"__e_{o}") for o, c in lags.items()],
        *[F.sum(c).alias(f"__e_{o}") for o, c in sums.items()],
    )
    edges = edges.select(
        *part,
        *[F.lag(f"__e_{o}").over(per_key).alias(f"__p_{o}") for o in lags],
        *[F.sum(f"__e_{o}").over(before).alias(f"__p_{o}") for o in sums],
    )
    scanned = df.withColumns(
        {
            **{f"__l_{o}": F.lag(c).over(local) for o, c in lags.items()},
            **{f"__l_{o}": F.sum(c).over(running) for o, c in sums.items()},
            "__first": F.row_number().over(local) == 1,
        }
    )
    joined = scanned.join(edges, part)
    outs: dict[str, Column] = {}
    for o in lags:
        outs[o] = F.when(F.col("__first"), F.col(f"__p_{o}")).otherwise(F.col(f"__l_{o}"))
    for o, c in sums.items():
        zero = F.lit(0).cast(df.schema[c].dataType)
        outs[o] = F.coalesce(F.col(f"__p_{o}"), zero) + F.col(f"__l_{o}")
    temp = [f"__{t}_{o}" for t in "lp" for o in (*lags, *sums)]
    return joined.withColumns(outs).drop(KEY, CHUNK, "__first", *temp)


def gap_groups(df: DataFrame, keys: Sequence[str], order: str, *, gap: int, width: int, out: str) -> DataFrame:
    """Number the runs of ``order`` values per key, a new run where the step exceeds ``gap`` (0-based).

    One row per (keys, order) is expected. Breaks inside a chunk and breaks between chunks are
    counted apart, so one join gives the run number.
    """
    part = [KEY, CHUNK]
    df = with_chunk(df, keys, F.floor(F.col(order) / F.lit(width)))
    local = Window.partitionBy(*part).orderBy(order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_key = Window.partitionBy(KEY).orderBy(CHUNK)

    step = F.col(order) - F.lag(order).over(local)
    marked = df.withColumn("__inner", F.coalesce((step > F.lit(gap)).cast("long"), F.lit(0).cast("long")))
    edges = marked.groupBy(*part).agg(
        F.min(order).alias("__lo"), F.max(order).alias("__hi"), F.sum("__inner").alias("__n")
    )
    between = F.coalesce((F.col("__lo") - F.lag("__hi").over(per_key) > F.lit(gap)).cast("long"), F.lit(0).cast("long"))
    edges = edges.withColumn("__between", between)
    upto = per_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *part,
        (F.sum("__between").over(upto) + F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).alias("__base"),
    )
    scanned = marked.withColumn("__local", F.sum("__inner").over(running))
    return (
        scanned.join(edges, part)
        .withColumn(out, F.col("__base") + F.col("__local"))
        .drop(KEY, CHUNK, "__inner", "__local", "__base")
    )


def global_row_number(df: DataFrame, hex_col: str, ties: Sequence[str], out: str, digits: int = 4) -> DataFrame:
    """1-based row number over the whole table in the order (hash text, ``ties``).

    The hash prefix splits the table into at most 16**digits even ranges. Only that histogram
    (65,536 rows at most) is scanned in one task; the rows are numbered inside their own range.
    """
    ranged = df.withColumn(CHUNK, F.substring(F.col(hex_col), 1, digits))
    counts = ranged.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__base"))
    local = Window.partitionBy(CHUNK).orderBy(hex_col, *ties)
    return (
        ranged.withColumn("__local", F.row_number().over(local))
        .join(counts, CHUNK)
        .withColumn(out, F.col("__base") + F.col("__local"))
        .drop(CHUNK, "__base", "__local")
    )


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row as a scalar subquery (null when it is empty)."""
    packed = row.select(F.struct(*row.columns).alias("__row")).scalar()
    return df.withColumn("__row", packed).select(
        *df.columns, *[F.col(f"__row.{c}").alias(c) for c in row.columns]
    )
