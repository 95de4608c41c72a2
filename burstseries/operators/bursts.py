"""Burst events: values at active bins and the gaps between them, as arrays or in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstseries.functions.arrays import head, item_rows, let
from burstseries.functions.ordered import KEY, chunked_scan, packed_key

# Fixed pattern: the summary line of a ping run; the second figure is the mean.
RTT_MEAN = r"rtt\s+min/avg/max/mdev\s*=\s*[^/]+/([^/]+)/[^/]+/[^\s]+\s*ms"

CHUNK_BINS = 65_536


def rtt_mean(text: Column) -> Column:
    """Mean round-trip time of a ping summary line, null when the line does not match."""
    return F.regexp_extract(text, RTT_MEAN, 1).try_cast("double")


def sampling_audit(samples: DataFrame, keys: Sequence[str], second: str, expected: int, chunk: int = 86_400):
    """Per key: intervals between samples, how many are not the expected one, their range and mean.

    Samples of one second are counted together first (they add intervals of length 0).
    """
    seconds = samples.groupBy(*keys, second).agg(F.count(F.lit(1)).alias("__n"))
    scanned = chunked_scan(seconds, keys, second, width=chunk, lags={"__prev": second})
    step = F.col(second) - F.col("__prev")
    same = F.col("__n") - 1
    off_same = same if expected != 0 else F.lit(0).cast("long")
    rows = scanned.select(
        *keys,
        (same + F.when(step.isNotNull(), 1).otherwise(0)).alias("__c"),
        (off_same + F.coalesce((step != expected).cast("long"), F.lit(0).cast("long"))).alias("__off"),
        F.coalesce(step, F.lit(0).cast("long")).alias("__sum"),
        F.when(same > 0, F.least(F.lit(0).cast("long"), step)).otherwise(step).alias("__min"),
        F.when(same > 0, F.greatest(F.lit(0).cast("long"), step)).otherwise(step).alias("__max"),
    )
    out = rows.groupBy(*keys).agg(
        F.sum("__c").alias("interval_count"),
        F.sum("__off").alias("non_expected_count"),
        F.min("__min").alias("min_interval_sec"),
        F.max("__max").alias("max_interval_sec"),
        F.sum("__sum").alias("__total"),
    )
    return (
        out.filter(F.col("interval_count") > 0)
        .withColumn("avg_interval_sec", F.col("__total") / F.col("interval_count"))
        .drop("__total")
    )


def audit_totals(audit: DataFrame, strict: bool = False) -> DataFrame:
    """Totals over all keys; ``strict`` makes the query fail when an unexpected interval exists."""
    bad = F.sum("non_expected_count")
    out = audit.agg(
        F.count(F.lit(1)).alias("entities_with_intervals"),
        F.coalesce(F.sum("interval_count"), F.lit(0).cast("long")).alias("total_intervals"),
        F.coalesce(bad, F.lit(0).cast("long")).alias("non_expected_total"),
        F.coalesce(F.sum((F.col("non_expected_count") > 0).cast("long")), F.lit(0).cast("long")).alias(
            "entities_with_non_expected"
        ),
    )
    if strict:
        check = F.when(
            F.col("non_expected_total") > 0, F.raise_error(F.lit("unexpected sampling intervals found")).cast("long")
        ).otherwise(F.col("non_expected_total"))
        out = out.withColumn("non_expected_total", check)
    return out


def burst_rows(
    bins: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    threshold: float,
    min_bursts: int = 1,
    max_bursts: int | None = None,
    unit: int = 1,
    chunk_bins: int = CHUNK_BINS,
) -> DataFrame:
    """Long form: ``(key, pos, bin, bi, ibg)`` of bins with value >= threshold; the first gap is 0.

    A key is kept when it has ``min_bursts``; ``max_bursts`` keeps its first ones. A key's bins are
    scanned in time chunks, so no task holds more than ``chunk_bins`` of them.
    """
    active = bins.filter(F.col(value) >= threshold).select(*keys, "bin", F.col(value).alias("bi"))
    if min_bursts > 1:
        counts = active.groupBy(packed_key(keys).alias(KEY)).agg(F.count(F.lit(1)).alias("__n"))
        enough = counts.filter(F.col("__n") >= min_bursts).select(KEY)
        active = active.withColumn(KEY, packed_key(keys)).join(enough, KEY, "left_semi").drop(KEY)
    active = active.withColumn("__one", F.lit(1).cast("long"))
    scanned = chunked_scan(active, keys, "bin", width=chunk_bins, lags={"__prev": "bin"}, sums={"__pos": "__one"})
    gap = F.coalesce(F.col("bin") - F.col("__prev"), F.lit(0).cast("long")) * unit
    out = scanned.select(*keys, (F.col("__pos") - 1).alias("pos"), "bin", "bi", gap.alias("ibg"))
    return out if max_bursts is None else out.filter(F.col("pos") < max_bursts)


def gather_bursts(rows: DataFrame, keys: Sequence[str], keep_bins: bool = False) -> DataFrame:
    """Long form to one row per key with ordered arrays; ``rows`` has been cut to a number per key."""
    cell = F.struct("pos", "bin", "bi", "ibg")
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("__c"))
    part = {n: F.col(f"__c.{n}") for n in ("bin", "bi", "ibg")}
    out = got.select(
        *keys,
        F.get(part["bin"], F.lit(0)).alias("first_bin"),
        part["bi"].alias("bi"),
        part["ibg"].alias("ibg"),
        *([part["bin"].alias("active_bins")] if keep_bins else []),
    )
    return out


def active_cells(arr: Column, threshold: float, bins: Column | None = None) -> Column:
    """``(bin, v)`` of the items at or over the threshold; the bin is the position unless ``bins`` is given.

    With threshold 0 every item, also a zero, is active.
    """
    cells = F.transform(
        arr,
        lambda x, i: F.struct((i.cast("long") if bins is None else F.get(bins, i)).alias("bin"), x.alias("v")),
    )
    return F.filter(cells, lambda c: c["v"] >= threshold)


def gaps(cells: Column, unit: int = 1) -> Column:
    def steps(own: Column) -> Column:
        return F.transform(
            own,
            lambda c, i: F.when(i == 0, F.lit(0).cast("long"))
            .otherwise(c["bin"] - F.get(own, i - 1)["bin"])
            .cast("long")
            * unit,
        )

    return let(cells, steps)


def bursts_from_series(
    series: DataFrame,
    keys: Sequence[str],
    column: str = "inbound",
    *,
    threshold: float,
    min_len: int,
    max_len: int | None = None,
    unit: int = 1,
    value_type: str = "long",
    bins: Column | None = None,
    keep_bins: bool = False,
) -> DataFrame:
    """Dense arrays to burst arrays without a shuffle; null arrays count as empty.

    ``unit`` turns gaps into milliseconds or seconds; ``bins`` gives absolute bins where known.
    """
    empty = F.array().cast(series.schema[column].dataType)
    cells = series.withColumn("__c", active_cells(F.coalesce(F.col(column), empty), threshold, bins))
    enough = cells.filter(F.size("__c") >= max(min_len, 1))
    if max_len is not None:
        enough = enough.withColumn("__c", head("__c", max_len))
    at = F.transform("__c", lambda c: c["bin"])
    return enough.select(
        *keys,
        F.get(at, F.lit(0)).alias("first_bin"),
        F.transform("__c", lambda c: c["v"].cast(value_type)).alias("bi"),
        gaps(F.col("__c"), unit).alias("ibg"),
        *([at.alias("active_bins")] if keep_bins else []),
    )


def bursts_from_chunks(
    chunks: DataFrame, keys: Sequence[str], *, threshold: float, min_len: int, unit: int = 1, keep_bins: bool = False
) -> DataFrame:
    """Burst arrays of dense chunks with absolute bins: ``bins``, else ``first_bin + i``, else ``i``."""
    n = F.size("inbound")
    if "bins" in chunks.columns:
        bins = F.col("bins")
    elif "first_bin" in chunks.columns:
        bins = F.when(n > 0, F.sequence(F.col("first_bin"), F.col("first_bin") + n - 1))
    else:
        bins = F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))
    if "example_id" not in chunks.columns:
        chunks = chunks.withColumn("example_id", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    return bursts_from_series(
        chunks.withColumn("__bins", bins),
        [*keys, "example_id"],
        threshold=threshold,
        min_len=min_len,
        unit=unit,
        value_type="double",
        bins=F.col("__bins"),
        keep_bins=keep_bins,
    )


def burst_chunks(rows: DataFrame, keys: Sequence[str], seq_len: int, store_bins: bool = False) -> DataFrame:
    """Long-form bursts to whole chunks of ``seq_len`` bursts; the first gap of each chunk is 0.

    Rows are grouped by (key, chunk), never by key alone.
    """
    numbered = rows.withColumns(
        {"chunk_idx": F.floor(F.col("pos") / seq_len).cast("int"), "pos": F.col("pos") % seq_len}
    )
    numbered = numbered.withColumn("ibg", F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.col("ibg")).cast("long"))
    out = gather_bursts(numbered, [*keys, "chunk_idx"], store_bins).filter(F.size("bi") == seq_len)
    return out.withColumn("example_id", F.concat_ws("_", *[F.col(k).cast("string") for k in (*keys, "chunk_idx")]))


def burst_long(bursts: DataFrame, keys: Sequence[str], arrays: Sequence[str] = ("bi", "ibg")) -> DataFrame:
    """Burst arrays to one row per burst."""
    rows = item_rows(bursts, [*keys, "first_bin"], F.arrays_zip(*arrays), item="__z")
    return rows.select(
        *keys, "first_bin", F.col("pos").cast("long").alias("pos"), *[F.col(f"__z.{a}").alias(a) for a in arrays]
    )


def rebuild_bins(bursts: DataFrame, keys: Sequence[str], unit: int = 1) -> DataFrame:
    """Burst arrays to ``(key, pos, bin)``: running sum of the gaps from the first bin.

    Series are grouped by their whole key, so a group is one series of bounded length.
    """
    long = burst_long(bursts, keys, ["ibg"])
    steps = long.withColumn("__s", F.floor(F.col("ibg") / F.lit(unit)).cast("long") if unit != 1 else F.col("ibg"))
    scanned = chunked_scan(steps, keys, "pos", width=CHUNK_BINS, sums={"__t": "__s"})
    return scanned.select(*keys, "pos", (F.col("first_bin") + F.col("__t")).alias("bin"))


def segment_length(gap: Column, cap: int | None = None) -> Column:
    """Timeline slots of one burst: its gap as a whole number from 1 on, at most ``cap`` if given; NaN and
    infinities give 1."""
    g = gap.cast("double")
    usable = ~F.isnan(g) & (F.abs(g) != float("inf"))
    slots = F.greatest(F.floor(g), F.lit(1))
    slots = slots if cap is None else F.least(slots, F.lit(cap))
    return F.when(usable, slots).otherwise(F.lit(1)).cast("int")


def expand_timeline(ibg: Column, bi: Column, cap: int | None = None) -> Column:
    """Per burst (gap - 1) zeros, then its value, over the common length of both arrays."""
    zero = F.lit(0.0)

    def spread(s: Column) -> Column:
        n = F.least(F.size(s["g"]), F.size(s["v"]))
        parts = F.zip_with(
            head(s["g"], n),
            head(s["v"], n),
            lambda g, v: F.concat(F.array_repeat(zero, segment_length(g, cap) - 1), F.array(v.cast("double"))),
        )
        return F.flatten(parts)

    return let(F.struct(ibg.alias("g"), bi.alias("v")), spread)


def bursts_covering(ibg: Column, prefix: Column, cap: int | None = None) -> Column:
    """Smallest number of leading bursts whose segments reach ``prefix`` slots, or all of them."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("k"), prefix.cast("long").alias("want"))
    walked = F.aggregate(
        ibg,
        start,
        lambda a, g: F.struct(
            (a["seen"] + segment_length(g, cap)).alias("seen"),
            (a["k"] + (a["seen"] < a["want"]).cast("int")).alias("k"),
            a["want"].alias("want"),
        ),
    )
    return F.when(prefix <= 0, F.lit(0)).otherwise(walked["k"])


