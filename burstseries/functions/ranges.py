"""Value ranges of one key: the way past a window over all distinct values of a hot key.

A key with more rows than a task should hold is cut at approximate quantiles of its own values, ranges that are
still too large are cut again, so every range is bounded whatever the key's share of the table and however its
values are spread. Ranges only decide which rows are scanned together; results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstseries.functions.arrays import index_below, lit_array
from burstseries.functions.ordered import chunked_scan, packed_key
from burstseries.session import cut_lineage

WIDTH = 65_536  # rows of one range
CUTS = 63  # a range is cut into at most one more
LAST = 1 << 62  # range of nulls


def value_ranges(df: DataFrame, keys: Sequence[str], value: str, *, out: str, width: int = WIDTH) -> DataFrame:
    """Add the range number ``out``: per key it does not fall as ``value`` grows, nulls come last.

    A range holds at most about ``width`` rows unless they are all of one value. Only ranges that are too large
    are looked at again; their number is at most rows / ``width``, and a round divides them by 64.
    """
    probes = lit_array([i / (CUTS + 1) for i in range(1, CUTS + 1)])
    marked = df.withColumns({"__rk": packed_key(keys), out: F.when(F.col(value).isNull(), F.lit(LAST)).otherwise(F.lit(0)).cast("long")})
    marked = cut_lineage(marked, "ranges")  # read by every step that follows
    while True:
        sizes = marked.groupBy("__rk", F.col(out).alias("__r")).agg(
            F.count(F.lit(1)).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi")
        )
        large = cut_lineage(sizes.filter((F.col("__n") > width) & (F.col("__lo") < F.col("__hi"))).select(F.col("__rk").alias("__k"), "__r"), "ranges-large")
        if large.isEmpty():
            return marked.drop("__rk")
        here = (F.col("__rk") == F.col("__k")) & (F.col(out) == F.col("__r"))
        cuts = marked.join(large, here).groupBy("__k", "__r").agg(F.percentile_approx(value, probes, F.lit(20 * CUTS)).alias("__cuts"))
        joined = marked.join(cut_lineage(cuts, "ranges-cuts"), here, "left")
        # a value equal to a cut starts the next range, so a range with two values is always cut
        above = F.coalesce(F.lit(CUTS) - _not_above(F.col("__cuts"), F.col(value)), F.lit(0))
        finer = F.when(F.col(out) == LAST, F.col(out)).otherwise(F.col(out) * (CUTS + 1) + above)
        marked = cut_lineage(joined.withColumn(out, finer.cast("long")).drop("__k", "__r", "__cuts"), "ranges")


def _not_above(cuts, value):
    """Number of rising cuts above ``value``."""
    reverse = F.transform(F.reverse(cuts), lambda c: -c)
    return index_below(reverse, -value, CUTS)


def dense_ranks(distinct: DataFrame, keys: Sequence[str], value: str, *, out: str, descending: bool = False, width: int = WIDTH) -> DataFrame:
    """Add the dense rank of ``value`` within its keys to distinct (keys, value) rows; nulls come last.

    Rows are counted per range, counts are summed along the ranges of a key, and ranks are made inside a range, so
    no task holds more than a range.
    """
    signed = distinct.withColumn("__v", -F.col(value) if descending else F.col(value)).withColumn("__one", F.lit(1).cast("long"))
    ranged = value_ranges(signed, keys, "__v", out="__range", width=width)
    return chunked_scan(ranged, keys, "__v", chunk=F.col("__range"), sums={out: "__one"}).drop("__v", "__one", "__range")
