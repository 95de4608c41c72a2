"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Every document of a source starts with the same wished number of copies, its source's target over its
source's size. The whole part is given at once. The fractional parts are rounded by pairs: mass, measured
in words, moves between two documents at random until one of them has a whole number of copies; the other
carries the rest on. The expected number of copies of each document stays what it was and the words taken
from a source change only by the last carried document.

Documents of a source are dealt into chunks of about ``fan`` by hash, each chunk is settled on its own and
leaves at most one unsettled document; those form the chunks of the next level, until one is left per
source. So a source holding a third of all rows is as many chunks as its share asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstseries.functions.arrays import let
from burstseries.llm.common import stored, word_count
from burstseries.llm.registry import query, table


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Per source: its size in words, number of documents and target.

    Weights are dealt to the sources in code point order (null last), repeating. The targets share
    ``share`` times all words by weight; none goes above ``most`` times its source's words, and what is
    cut off is shared again by weight. Sorted by the level at which they reach their bound, the bounded
    sources come first, so one pass over the sources (one row each) finds the common level of the others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(place) - 1) % len(weights)) + 1)
    per = per.withColumn("weight", w)
    per = per.withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumns({"level": left / weight_left, "at": F.row_number().over(order)})
    per = per.withColumn("full", F.col("level") * F.col("weight") >= F.col("bound"))
    common = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(whole)["level"]
    target = F.when(F.col("full"), F.col("bound")).otherwise(common * F.col("weight"))
    return per.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def _unit(*cols: Column) -> Column:
    """A stable number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _settled(p: Column) -> Column:
    return (p <= 0) | (p >= 1)


def _move(a: Column, b: Column, level: int, seed: int) -> Column:
    """Move words between ``a`` and ``b`` until one is settled; gives both, the settled one first."""
    ratio = b["size"] / a["size"]
    up_a, up_b = F.lit(1.0) - a["p"], b["p"] * ratio  # what a lacks, what b could give
    down_a, down_b = a["p"], (F.lit(1.0) - b["p"]) * ratio
    up, down = F.least(up_a, up_b), F.least(down_a, down_b)
    rises = _unit(F.lit(seed), F.lit(level), a["h"], b["h"]) * (up + down) < down
    new_a = F.when(rises, F.when(up_a <= up_b, 1.0).otherwise(a["p"] + up)).otherwise(
        F.when(down_a <= down_b, 0.0).otherwise(a["p"] - down)
    )
    new_b = F.when(rises, F.when(up_a >= up_b, 0.0).otherwise(b["p"] - up / ratio)).otherwise(
        F.when(down_a >= down_b, 1.0).otherwise(b["p"] + down / ratio)
    )
    def with_p(x, p):
        return F.struct(x["size"].alias("size"), x["h"].alias("h"), x["id"].alias("id"), p.alias("p"))

    pair = F.struct(with_p(a, new_a).alias("a"), with_p(b, new_b).alias("b"))
    return let(pair, lambda x: F.when(_settled(x["a"]["p"]), x).otherwise(F.struct(x["b"].alias("a"), x["a"].alias("b"))))


def _settle(chunk: Column, level: int, seed: int) -> Column:
    """Run through a chunk carrying one unsettled document: struct(cur, out)."""
    start = F.struct(F.get(chunk, F.lit(0)).alias("cur"), F.slice(chunk, 1, 0).alias("out"))

    def step(acc, b):
        moved = let(
            _move(acc["cur"], b, level, seed),
            lambda x: F.struct(x["b"].alias("cur"), F.concat(acc["out"], F.array(x["a"])).alias("out")),
        )
        flush = F.struct(b.alias("cur"), F.concat(acc["out"], F.array(acc["cur"])).alias("out"))
        return F.when(_settled(acc["cur"]["p"]), flush).otherwise(moved)

    return F.aggregate(F.slice(chunk, 2, F.greatest(F.size(chunk) - 1, F.lit(0))), start, step)


def pivotal_copies(sized: DataFrame, targets: DataFrame, *, fan: int = 32, seed: int = 7) -> DataFrame:
    """Number of ``copies`` for every row of ``sized`` (source, size, id: any value, key: what is hashed).

    Rows are told apart by nothing but their place, so repeated rows are drawn separately. Documents
    without words get copies by an independent draw, as they have no mass to move. Reruns agree: order
    and random numbers come from hashes of (key, size).
    """
    rows = sized.withColumn("h", F.xxhash64(F.lit(seed), "key", "size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumnsRenamed({"source": "t_source"})
    rows = rows.join(t, rows["source"].eqNullSafe(t["t_source"])).drop("t_source")
    rows = rows.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9).cast("long"))
    rows = rows.withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-9, F.lit(0.0)).otherwise(F.col("p")))
    rows = rows.withColumn(
        "p", F.when(F.col("size") > 0, F.col("p")).otherwise((_unit(F.lit(seed), F.col("h")) < F.col("p")).cast("double"))
    )
    chunks = F.ceil(F.col("n_docs") / fan).cast("long")
    rows = rows.withColumn("chunk", F.pmod(F.col("h"), F.greatest(chunks, F.lit(1))))
    item = F.struct("size", "h", "id", "p")
    keys = ["source", "source_size", "target", "base"]
    most = targets.agg(F.max(F.ceil(F.col("n_docs") / fan))).first()[0] or 1

    def settle(df: DataFrame, level: int) -> DataFrame:
        got = df.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        return stored(got.select(*keys, "chunk", _settle(F.col("items"), level, seed).alias("r")), "mix-level")

    fixed = _settled(F.col("p"))
    done = [rows.filter(fixed).select(*keys, item.alias("item"))]
    level, open_rows = 0, rows.filter(~fixed).select(*keys, "chunk", item.alias("item"))
    while True:
        got = settle(open_rows, level)
        done.append(got.select(*keys, F.explode("r.out").alias("item")))
        cur = got.select(*keys, F.floor(F.col("chunk") / fan).alias("chunk"), F.col("r.cur").alias("item"))
        done.append(cur.filter(_settled(F.col("item.p"))).drop("chunk"))
        open_rows = cur.filter(~_settled(F.col("item.p")))
        if most <= 1:
            break
        most, level = -(-most // fan), level + 1
    last = _unit(F.lit(seed), F.lit(-1), F.col("item.h")) < F.col("item.p")
    done.append(
        open_rows.select(
            *keys,
            F.struct(
                F.col("item.size"), F.col("item.h"), F.col("item.id"), last.cast("double").alias("p")
            ).alias("item"),
        )
    )
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(
        F.col("item.id").alias("id"), F.col("item.size").alias("size"), "source", "source_size", "target",
        (F.col("base") + F.col("item.p").cast("long")).alias("copies"),
    )


def mix(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Copies per document, by id. Null text: size 0. Null source: a source of its own, placed last.

    An empty table gives an empty result; further columns of ``docs`` are not looked at.
    """
    sized = docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("key"), F.col("source"), word_count("text").alias("size")
    )
    sized = stored(sized, "mix-sizes")
    targets = stored(source_targets(sized, weights, share, most), "mix-targets")
    return pivotal_copies(sized, targets)


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns of ``docs``.

    The rows are stored once with a number of their own, so repeated and null ids need no care.
    """
    cols = docs.columns
    numbered = stored(
        docs.withColumns({"__n": F.monotonically_increasing_id(), "__size": word_count("text")}), "mix-documents"
    )
    sized = numbered.select(
        F.col("__n").alias("id"), F.col("doc_id").alias("key"), "source", F.col("__size").alias("size")
    )
    targets = stored(source_targets(sized, **kw), "mix-targets")
    picks = pivotal_copies(sized, targets).filter(F.col("copies") > 0).select(F.col("id").alias("__n"), "copies")
    out = numbered.join(stored(picks, "mix-picks"), "__n")
    return out.select(*cols, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
