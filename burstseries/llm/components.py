"""Connected components of a graph given as edges, by alternating star contraction; all steps are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstseries.llm.common import discard, stored


def _star(pairs: DataFrame, large: bool, name: str) -> DataFrame:
    """Neighbours relinked to the smallest of their vertex: the larger ones (large star) or the smaller ones.

    ``pairs`` are (a, b) with b < a. The smallest neighbour is found with partial sums and stored, so that the
    join with it is between stored tables, whose large keys Spark splits.
    """
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    low = stored(sides.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-low")
    linked = sides.join(low, sides["a"] == low["v"])
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
    out = stored(out.filter("a <> b").distinct(), name)
    discard(low)
    return out


def component_labels(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable, for every vertex of ``edges`` (a, b); undirected.

    Rounds of large star and small star until nothing changes; their number grows with the logarithm of the
    longest path, whatever the order of the ids, and they end by themselves: every round that changes a link
    gives some vertex a smaller one. Rounds are written to the shared folder, spent ones deleted.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = stored(pairs.distinct(), "cc-0")

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, i = print_of(pairs), 0
    vertices = stored(pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct(), "cc-vertices")
    while True:
        i += 1
        half = _star(pairs, True, f"cc-{i}a")
        discard(pairs)
        pairs = _star(half, False, f"cc-{i}b")
        discard(half)
        now = print_of(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("a").alias("r"), F.col("b").alias("label"))
    labels = vertices.join(roots, F.col("v") == F.col("r"), "left").select("v", F.coalesce("label", "v").alias("label"))
    return stored(labels, "cc-labels")
