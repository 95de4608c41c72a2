"""Exact order statistics per group by bracketed multi-select.

Every wanted rank lies in a bracket of values, at first its group's whole span. A round takes approximate quantiles
of the brackets that are too large, counts the rows below, at and between them with partial sums, and keeps
only the parts that hold a wanted rank. What is left of a bracket is sorted once it has at most ``limit`` rows. A
round divides a bracket by about 64; the approximation decides how fast it goes, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstseries.functions.arrays import index_below, lit_array
from burstseries.functions.ordered import chunked_scan, join_on, packed_key, with_row
from burstseries.functions.ranges import WIDTH, value_ranges
from burstseries.session import cut_lineage

LIMIT = 4096  # rows of a bracket that are sorted in one group
CUTS = 63


def _wanted_ranks(levels: Sequence[float], n: Column) -> Column:
    """0-based ranks on both sides of every level's position, sorted."""
    at = [F.lit(float(q)) * (n - 1) for q in levels]
    both = [f(p).cast("long") for p in at for f in (F.floor, F.ceil)]
    return F.array_sort(F.array_distinct(F.array(*both)))


def _within(ranks: Column, below: Column, rows: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= below) & (r < below + rows))


def values_at_group_ranks(values: DataFrame, groups: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(k, rank, value) for ``values`` (k, v, w) and ``groups`` (k, lo, hi, m, ranks): 0-based ranks of each k's sorted values.

    A row stands for ``w`` equal values, for one if there is no such column; ``m`` counts a group's rows.
    """
    if "w" not in values.columns:
        values = values.withColumn("w", F.lit(1).cast("long"))
    probes = lit_array([i / (CUTS + 1) for i in range(1, CUTS + 1)])
    found = []
    open_ = groups.select(F.col("k").alias("bk"), "lo", "hi", F.lit(0).cast("long").alias("below"), "m", "ranks")
    data = values
    while True:
        one = open_.filter(F.col("lo") == F.col("hi"))
        found.append(one.select(F.col("bk").alias("k"), F.explode("ranks").alias("rank"), F.col("lo").alias("value")))
        inside = (F.col("k") == F.col("bk")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        small = open_.filter((F.col("lo") < F.col("hi")) & (F.col("m") <= limit))
        upto = F.sum("w").over(Window.partitionBy("bk", "lo").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # ``limit`` rows at most
        rows = data.join(small, inside).select("bk", "v", "w", "ranks", (F.col("below") + upto - F.col("w")).alias("at"))
        found.append(rows.select(F.col("bk").alias("k"), F.explode(_within(F.col("ranks"), F.col("at"), F.col("w"))).alias("rank"), F.col("v").alias("value")))
        large = cut_lineage(open_.filter((F.col("lo") < F.col("hi")) & (F.col("m") > limit)), "select-large")
        if large.isEmpty():
            break
        cuts = data.join(large, inside).groupBy("bk", "lo").agg(F.percentile_approx("v", probes, F.lit(20 * CUTS)).alias("cuts"))
        cut = large.join(cuts.withColumnsRenamed({"bk": "ck", "lo": "clo"}), (F.col("bk") == F.col("ck")) & (F.col("lo") == F.col("clo"))).drop("ck", "clo")
        cut = cut_lineage(cut, "select-cuts")
        at = index_below(F.col("cuts"), F.col("v"), CUTS)
        slot = 2 * at + F.coalesce((F.get("cuts", at) == F.col("v")).cast("int"), F.lit(0))
        parts = data.join(cut.select("bk", "lo", "hi", "cuts"), inside).groupBy("bk", F.col("lo").alias("of"), slot.alias("slot")).agg(
            F.count(F.lit(1)).alias("m"), F.sum("w").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        held = large.select(F.col("bk").alias("hk"), F.col("lo").alias("hlo"), F.col("below").alias("base"), "ranks")
        parts = parts.join(held, (F.col("bk") == F.col("hk")) & (F.col("of") == F.col("hlo")))
        before = Window.partitionBy("bk", "of").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # 127 rows at most
        parts = parts.withColumn("below", F.col("base") + F.coalesce(F.sum("all").over(before), F.lit(0)))
        parts = parts.withColumn("ranks", _within(F.col("ranks"), F.col("below"), F.col("all"))).filter(F.size("ranks") > 0)
        open_ = cut_lineage(parts.select("bk", "lo", "hi", "below", "m", "ranks"), "select-open")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def grouped_percentiles(
    df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float], *, out: str = "percentiles", limit: int = LIMIT
) -> DataFrame:
    """(by, ``out``: array of the interpolated percentiles at ``levels``, n): nulls left out, NaN above all numbers.

    A group without values has a null array; without ``by`` there is always one row. Groups of any size take
    the same way: no group's values meet in one buffer beyond ``limit`` of them. The source is read once: equal values
    are counted before anything is shuffled, and every round reads the counts.
    """
    levels = [float(q) for q in levels]
    keyed = df.select(packed_key(by).alias("k"), F.col(value).cast("double").alias("v"))
    counted = cut_lineage(keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("w")), "select-values")
    keys = [F.col("k").getField(b).alias(b) for b in by]
    known = F.col("v").isNotNull()
    facts = counted.select("k", *keys, "v", "w").groupBy(*by).agg(
        F.first("k").alias("k"),
        F.coalesce(F.sum(F.when(known, F.col("w"))), F.lit(0).cast("long")).alias("n"),
        F.count("v").alias("m"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    )
    facts = cut_lineage(facts, "select-groups")
    groups = facts.filter(F.col("n") > 0).select("k", "lo", "hi", "m", _wanted_ranks(levels, F.col("n")).alias("ranks"))
    got = values_at_group_ranks(counted.filter(known), groups, limit)
    got = got.groupBy(F.col("k").alias("gk")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def level(q: float) -> Column:
        pos = F.lit(q) * (F.col("n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        a, b = F.col("at")[low.cast("long")], F.col("at")[high.cast("long")]
        return F.when((low == high) | (a == b), a).otherwise((high - pos) * a + (pos - low) * b)

    joined = facts.join(got, F.col("k") == F.col("gk"), "left")
    return joined.select(*by, F.when(F.col("n") > 0, F.array(*[level(q) for q in levels])).alias(out), "n")


def column_medians(df: DataFrame, columns: Mapping[str, str], limit: int = LIMIT) -> DataFrame:
    """One row: the exact median of each column, named by the keys of ``columns``; nulls and NaN left out."""
    sources = sorted(set(columns.values()))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias("v")) for c in sources])
    got = grouped_percentiles(df.select(F.inline(pairs)), ["name"], "v", [0.5], limit=limit)
    one = got.agg(*[F.max(F.when(F.col("name") == c, F.get("percentiles", F.lit(0)))).alias(f"m{i}") for i, c in enumerate(sources)])
    return one.select(*[F.col(f"m{sources.index(c)}").alias(n) for n, c in columns.items()])


def running_counts(df: DataFrame, by: Sequence[str], value: str, *, width: int = WIDTH) -> DataFrame:
    """(by, value, n, upto, total): each distinct value's rows, the rows up to it and the rows of its group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    counts = value_ranges(counts, by, value, out="__range", width=width)
    run = chunked_scan(counts, by, value, chunk=F.col("__range"), sums={"upto": "n"}).drop("__range")
    totals = cut_lineage(counts.groupBy(*by).agg(F.sum("n").alias("total")), "group-totals")
    return join_on(run, totals, list(by)) if by else with_row(run, totals)
