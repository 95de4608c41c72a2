"""Values to token ids and back: global quantile bins, per-series bins, whole-number gap bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstseries.functions.arrays import index_below, let, lit_array

SMALLEST_VALID = 1e-12


def is_valid(v: Column) -> Column:
    d = v.cast("double")
    return F.coalesce(~F.isnan(d) & (d >= SMALLEST_VALID), F.lit(False))


def _clamp(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def encode_global(values: Column, edges: Sequence[float], *, n_special: int, n_tokens: int, pad: int = 0) -> Column:
    """Array of values to ids: edges below the value + ``n_special``; pad where the value is not valid."""
    table = lit_array(edges)

    def one(v: Column) -> Column:
        at = index_below(table, v.cast("double"), len(edges)) + n_special
        return F.when(is_valid(v), _clamp(at, 0, n_tokens - 1)).otherwise(F.lit(pad)).cast("int")

    return F.transform(values, one)


def decode_global(ids: Column, edges: Sequence[float], *, n_special: int, decode: str = "own_bin") -> Column:
    """Ids to bin centres.

    ``reference`` returns the centre of the bin above the one a value was encoded into,
    ``own_bin`` (default) the centre of the value's own bin. An unbounded last edge is replaced by
    the edge before it.
    """
    centers = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    if not edges[-1] < 1e19:
        centers[-1] = edges[-2]
    shift = {"reference": 0, "own_bin": 1}[decode]
    table = lit_array(centers)
    return F.transform(ids, lambda t: F.get(table, _clamp(t - n_special - shift, 0, len(centers) - 1)))


def local_edges(values: Column, bins: int) -> Column:
    """``bins - 1`` inner quantiles (linear) of a series' own valid items; empty data gives zeros."""
    valid = F.array_sort(F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: is_valid(v)))

    def cuts(ordered: Column) -> Column:
        n = F.size(ordered)

        def at(level: Column) -> Column:
            where = level * (n - 1)
            lo = F.floor(where).cast("int")
            a, b = F.get(ordered, lo), F.get(ordered, F.least(lo + 1, n - 1))
            return F.coalesce(a + (b - a) * (where - lo), F.lit(0.0))

        return F.transform(lit_array([i / bins for i in range(1, bins)]), at)

    return let(valid, cuts)


def encode_local(values: Column, edges: Column, *, bins: int, n_special: int, n_tokens: int, pad: int = 0) -> Column:
    """Ids by the series' own edges; with no bins every valid item gets the first real id."""

    def all_ids(own: Column) -> Column:
        def one(v: Column) -> Column:
            at = index_below(own, v.cast("double"), bins - 1) + n_special if bins > 0 else F.lit(n_special)
            return F.when(is_valid(v), _clamp(at, 0, n_tokens - 1)).otherwise(F.lit(pad)).cast("int")

        return F.transform(values, one)

    return let(edges, all_ids)


def encode_integer(values: Column, *, bins: int, n_special: int, n_tokens: int, pad: int = 0) -> Column:
    """Whole-number gaps: rounded half to even, clamped to [0, bins - 1]; 0 is valid, negatives are pads."""
    bins = max(1, min(int(bins), n_tokens - n_special))

    def one(v: Column) -> Column:
        d = v.cast("double")
        ok = F.coalesce(~F.isnan(d) & (F.abs(d) != float("inf")) & (d >= 0), F.lit(False))
        safe = F.when(ok, _clamp(F.rint(d), 0.0, float(bins - 1))).otherwise(F.lit(0.0)).cast("int")
        return F.when(ok, _clamp(safe + n_special, 0, n_tokens - 1)).otherwise(F.lit(pad)).cast("int")

    return F.transform(values, one)


def decode_integer(ids: Column, *, bins: int, n_special: int) -> Column:
    return F.transform(ids, lambda t: _clamp(t - n_special, 0, bins - 1).cast("double"))


def auto_bins(series: DataFrame, column: str, n_tokens: int) -> DataFrame:
    """Number of gap bins the data calls for: largest gap + 1, at least 2, at most ``n_tokens``."""
    top = F.max(F.array_max(column).cast("double"))
    return series.agg(F.least(F.greatest(F.lit(2), F.ceil(top).cast("int") + 1), F.lit(n_tokens)).alias("bins"))


def next_step_pairs(ids: Column, pad: int = 0, skip: int = 0) -> Column:
    """``(pos, token, target, valid)`` per position that has a successor.

    A pair is valid when its target is no pad; the first ``skip`` positions can be masked out.
    """
    n = F.size(ids)
    now, nxt = F.slice(ids, 1, F.greatest(n - 1, F.lit(0))), F.slice(ids, 2, F.greatest(n - 1, F.lit(0)))
    zipped = F.zip_with(now, nxt, lambda a, b: F.struct(a.alias("token"), b.alias("target")))
    return F.transform(
        zipped,
        lambda p, i: F.struct(
            i.alias("pos"),
            p["token"].alias("token"),
            p["target"].alias("target"),
            ((p["target"] != pad) & (i >= skip)).alias("valid"),
        ),
    )
