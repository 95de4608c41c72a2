"""Keys, shards and key-based filters and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstseries.functions.hashing import hash32
from burstseries.functions.ordered import join_on


def key_filter(
    column: Column, prefix: str | None = None, suffix: str | None = None, values: Sequence | None = None
) -> Column:
    """Condition: all given tests hold (starts with, ends with, is listed)."""
    text = column.cast("string")
    tests = [F.lit(True)]
    if prefix is not None:
        tests.append(text.startswith(prefix))
    if suffix is not None:
        tests.append(text.endswith(suffix))
    if values is not None:
        tests.append(column.isin(list(values)))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def hash_shard(df: DataFrame, keys: Sequence[str], shards: int, index: int) -> DataFrame:
    """The rows of one of ``shards`` key-hash parts: a sampling operator, whole keys stay together."""
    return df.filter(F.pmod(hash32(keys), F.lit(shards)) == index)


def first_k_keys(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Rows of the first ``k`` distinct keys in key order."""
    chosen = df.select(*keys).distinct().orderBy(*keys).limit(k)
    return df.join(chosen, on=list(keys), how="left_semi")


def allow_listed(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is in the list; repeated list rows do not repeat data."""
    return df.join(allowed.select(*keys), on=list(keys), how="left_semi")


def composite_key(columns: Sequence[str], sep: str) -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def unique_point_id(
    df: DataFrame, columns: Sequence[str], row_id: str, out: str = "point_id", sep: str = "::"
) -> DataFrame:
    """Joined ids; where an id occurs more than once, every copy gets its row id appended."""
    base = df.withColumn(out, composite_key(columns, sep))
    counts = base.groupBy(out).agg((F.count(F.lit(1)) > 1).alias("__many"))
    repeated = counts.filter("__many")
    joined = join_on(base, repeated, [out], "left")
    text = F.concat(F.col(out), F.lit(sep), F.col(row_id).cast("string"))
    return joined.withColumn(out, F.when(F.col("__many"), text).otherwise(F.col(out))).drop("__many")


def fill_lineage(df: DataFrame, session_column: str = "session_id", literal: str = "unknown") -> DataFrame:
    """``source_file`` as it is, else the session id as text, else a literal."""
    if "source_file" in df.columns:
        return df
    value = F.col(session_column).cast("string") if session_column in df.columns else F.lit(literal)
    return df.withColumn("source_file", value)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in a stated order, by a combining aggregate (no window sort)."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def dedup_join(tables: Sequence[DataFrame], keys: Sequence[str], orders: Sequence[Sequence[str]]) -> DataFrame:
    """Inner join of two or more tables after keeping the first row per key in each."""
    firsts = [first_per_key(t, keys, o) for t, o in zip(tables, orders, strict=True)]
    out = firsts[0]
    for nxt in firsts[1:]:
        out = out.join(nxt, on=list(keys), how="inner")
    return out


def left_join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails at run time when the right side repeats a key.

    The right side is aggregated per key anyway, so the check costs no further shuffle.
    """
    rest = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(c) for c in rest]
    )
    repeated = F.when(F.col("__n") > 1, F.raise_error(F.lit("right side repeats a key")).cast("boolean"))
    checked = once.filter(F.coalesce(repeated, F.lit(True))).drop("__n")
    return left.join(checked, on=list(keys), how="left")


def prefixed_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str = "_repr", how: str = "inner"
) -> DataFrame:
    """Join on keys cast to text; names of the right side that clash get a suffix."""
    as_text = {k: F.col(k).cast("string") for k in keys}
    taken = set(left.columns) - set(keys)
    names = {c: f"{c}{suffix}" if c in taken else c for c in right.columns if c not in keys}
    renamed = right.withColumns(as_text).withColumnsRenamed(names)
    return left.withColumns(as_text).join(renamed, on=list(keys), how=how)


def member_lookup(
    members: DataFrame, series: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]
) -> DataFrame:
    """Each member with its series; keys compare as text and the first series row per key is used.

    -1 and null items are dropped; a series with a NaN or infinite item counts as missing.
    """
    as_text = {k: F.col(k).cast("string") for k in keys}
    wanted = members.withColumns(as_text)
    found = series.withColumns(as_text).join(wanted.select(*keys).distinct(), on=list(keys), how="left_semi")
    chosen = first_per_key(found.select(*keys, value, *[c for c in order if c not in keys and c != value]), keys, order)
    clean = F.filter(F.col(value), lambda x: x.isNotNull() & (x != -1))
    bad = F.exists(clean, lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = chosen.select(*keys, F.when(~bad, clean).alias(value))
    return wanted.join(usable, on=list(keys), how="left").withColumn("found", F.col(value).isNotNull())


def member_counts(looked_up: DataFrame, group: str) -> DataFrame:
    """Found and missing members per group and over all groups (null group)."""
    one = F.col("found").cast("long")
    return looked_up.rollup(group).agg(F.sum(one).alias("found"), F.sum(1 - one).alias("missing"))


def member_sample(df: DataFrame, group: str, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows per group, picked by a seeded hash of (group, key).

    The cut is taken twice: first per (group, hash part), where a large group is spread over
    many tasks, then over the few survivors of each group.
    """
    scored = df.withColumns({"__h": hash32([group, *keys], seed), "__part": hash32(keys, "part") % 256})
    first = Window.partitionBy(group, "__part").orderBy("__h", *keys)
    last = Window.partitionBy(group).orderBy("__h", *keys)
    near = scored.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= n)
    return near.withColumn("sample_rank", F.row_number().over(last)).filter(F.col("sample_rank") <= n).drop(
        "__h", "__part", "__r"
    )
