"""Array expressions shared by the operators; all JVM-side and linear in the array length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named inside an item-by-item function would else be computed for every item.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def item_rows(df: DataFrame, keep, array: Column | str, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per array item with its 0-based position; rows with empty or null arrays vanish.

    The outer form is used and its null rows are dropped afterwards: for the plain form Spark adds a
    test of the array before the explode, which computes a derived array a second time.
    """
    out = df.select(*keep, F.posexplode_outer(col(array)).alias(pos, item))
    return out.filter(F.col(pos).isNotNull())


def total(arr: Column | str) -> Column:
    return F.aggregate(col(arr), F.lit(0.0), lambda a, x: a + x.cast("double"))


def total_long(arr: Column | str) -> Column:
    return F.aggregate(col(arr), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product over the common length."""
    pairs = F.zip_with(col(a), col(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return total(pairs)


def head(arr: Column | str, n: Column | int) -> Column:
    """First ``n`` items; ``n`` may be a column, and zero gives an empty array."""
    return F.slice(col(arr), F.lit(1), F.lit(n) if isinstance(n, int) else n)


def lit_array(values, dtype: str = "double") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{dtype}>")


def finite(x: Column) -> Column:
    """Null, NaN and the infinities all become null."""
    big = F.lit(float("inf"))
    return F.when(F.isnan(x) | (F.abs(x) == big), None).otherwise(x)


def keep_finite(arr: Column | str) -> Column:
    big = F.lit(float("inf"))
    return F.filter(
        col(arr),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != big),
    )


def count_where(arr: Column | str, test) -> Column:
    return F.size(F.filter(col(arr), test))


def l2_unit(arr: Column | str) -> Column:
    """NaN, infinities and nulls become 0, then the row is scaled to length 1 (zero rows stay zero)."""
    clean = F.transform(
        col(arr),
        lambda x: F.coalesce(finite(x.cast("double")), F.lit(0.0)),
    )
    norm = F.sqrt(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x * x))
    safe = F.when(norm == 0.0, F.lit(1.0)).otherwise(norm)
    return let(safe, lambda n: F.transform(clean, lambda x: x / n))


def index_below(edges: Column | str, value: Column, size: int | None = None) -> Column:
    """Number of sorted edges strictly below ``value`` (a left-side sorted search).

    With a known ``size`` over 32 the edges are halved step by step instead of all compared.
    """
    if size is None or size <= 32:
        return F.size(F.filter(col(edges), lambda e: e < value))
    arr = col(edges)

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / F.lit(2)).cast("int")
        below = (a["lo"] < a["hi"]) & F.coalesce(F.get(arr, mid) < value, F.lit(False))
        return F.struct(
            F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"),
            F.when(below, a["hi"]).otherwise(F.least(mid, a["hi"])).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))
    steps = F.sequence(F.lit(0), F.lit(size.bit_length()))
    return F.aggregate(steps, start, halve)["lo"]
