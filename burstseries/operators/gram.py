"""Cross-product sums of wide numeric rows, the shared pass behind similarity and geometry.

Each task adds up small matrices for the groups it holds and hands on one array per group, the upper triangle
packed; arrays are added in two steps, the first over salts of a group. Rows are centred by exact means first, so
large offsets do not cost precision.

Columns with missing values share that pass: rows of one pattern of missing columns are multiplied once, and the
product is kept once more for each column that lacks (or, where that is less, has) those rows. No row is copied.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstseries.functions.arrays import dot, finite, let, lit_array
from burstseries.functions.ordered import join_on, with_row
from burstseries.operators.features import to_long
from burstseries.session import cut_lineage

MAX_CELLS = 4_000_000


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every listed column is a number (no null, no NaN)."""
    packed = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return df.filter(~F.exists(packed, lambda x: x.isNull() | F.isnan(x)))


def rows_with_a_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which at least one listed column is a number."""
    packed = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return df.filter(F.exists(packed, lambda x: x.isNotNull() & ~F.isnan(x)))


def vector_means(vectors: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Count and mean vector per group; a group is spread over its dimensions."""
    long = vectors.select(*group, F.posexplode(vector).alias("dim", "__x"))
    cells = long.groupBy(*group, "dim").agg(F.avg("__x").alias("m"), F.count(F.lit(1)).alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return cells.groupBy(*group).agg(
        F.transform(packed, lambda c: c["m"]).alias("mean"), F.max("n").alias("n")
    )


def centered(vectors: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Vectors minus their group's mean, with the group's row count ``n``."""
    means = vector_means(vectors, group, vector)
    joined = join_on(vectors, means, group) if group else with_row(vectors, means)
    return joined.withColumn(
        vector, F.zip_with(F.col(vector), F.col("mean"), lambda x, m: x.cast("double") - m)
    ).drop("mean")


def cross_products(vectors: DataFrame, group: Sequence[str], vector: str, left: int | None = None) -> DataFrame:
    """``(group, i, j, s)``: sum over rows of ``v[i] * v[j]``.

    With ``left`` only i < left is paired with every j, plus the diagonal; otherwise all pairs.
    Partial sums leave a task when they outgrow a fixed number of cells, so many groups are safe.
    """
    group = list(group)
    fields = [vectors.schema[g] for g in group]
    schema = T.StructType(
        [
            *fields,
            T.StructField("i", T.IntegerType()),
            T.StructField("j", T.IntegerType()),
            T.StructField("s", T.DoubleType()),
        ]
    )

    def emit(sums: dict) -> Iterator[pd.DataFrame]:
        for key, (block, diag) in sums.items():
            rows, cols = block.shape
            i, j = np.divmod(np.arange(rows * cols), cols)
            s = block.ravel()
            if rows < cols:
                extra = np.arange(rows, cols)
                i, j = np.concatenate([i, extra]), np.concatenate([j, extra])
                s = np.concatenate([s, diag[rows:]])
            out = pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": s})
            for at, g in enumerate(group):
                out.insert(at, g, key[at])
            yield out

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        cells = 0
        for frame in frames:
            parts = [((), frame)] if not group else frame.groupby(group, sort=False, dropna=False)
            for key, part in parts:
                x = np.stack([np.asarray(v, dtype=float) for v in part[vector]])
                rows = x.shape[1] if left is None else left
                block, diag = x[:, :rows].T @ x, np.einsum("ij,ij->j", x, x)
                if key in sums:
                    sums[key][0][...] += block
                    sums[key][1][...] += diag
                else:
                    sums[key] = [block, diag]
                    cells += block.size
            if cells > MAX_CELLS:
                yield from emit(sums)
                sums, cells = {}, 0
        yield from emit(sums)

    partial = vectors.select(*group, vector).mapInPandas(batches, schema)
    return partial.groupBy(*group, "i", "j").agg(F.sum("s").alias("s"))


# ---- packed sums per group ----------------------------------------------------------------

GROUP_ID = "__gid"
PARTIAL = f"{GROUP_ID} long, part int, cells array<double>"


def triangle(d: int) -> int:
    return d * (d + 1) // 2


def unpacked(cells: np.ndarray, d: int) -> np.ndarray:
    """The symmetric matrix of a packed upper triangle."""
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = cells[: triangle(d)]
    return out + np.triu(out, 1).T


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(-1, width)


def _packed_sums(d: int, m: int, gaps: Mapping[int, bool]):
    """Per group, part 0: x with x, x with y, y with y, where a missing y counts as 0. Per column ``k`` of ``gaps``,
    part ``k + 1``: x with x and sums of x over the rows without a value of ``k`` (True) or with one (False)."""
    upper = np.triu_indices(d)
    columns = sorted(gaps)
    lacking = np.array([gaps[k] for k in columns], dtype=bool)

    def emit(sums: dict) -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        for lo in range(0, len(keys), 64):
            part = keys[lo : lo + 64]
            cols = [pa.array([k[0] for k in part], pa.int64()), pa.array([k[1] for k in part], pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([sums[k] for k in part], pa.list_(pa.float64()))], [GROUP_ID, "part", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        cells = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column(GROUP_ID).to_numpy()
            x = _matrix(batch.column("x"), d)
            y = _matrix(batch.column("y"), m) if m else np.zeros((len(gid), 0))
            gone = np.isnan(y)
            wanted = gone[:, columns] == lacking
            pattern = np.unique(np.packbits(wanted, axis=1), axis=0, return_inverse=True)[1].ravel() if columns else np.zeros(len(gid), dtype=int)
            y = np.where(gone, 0.0, y)
            order = np.lexsort((pattern, gid))
            cut = np.flatnonzero(np.diff(gid[order]) | np.diff(pattern[order])) + 1
            for rows in np.split(order, cut):
                g, xs, ys = int(gid[rows[0]]), x[rows], y[rows]
                square = (xs.T @ xs)[upper]
                adds = [((g, 0), np.concatenate([square, (ys.T @ xs).ravel(), np.einsum("ij,ij->j", ys, ys)]))]
                total = np.concatenate([square, xs.sum(axis=0)])
                adds += [((g, columns[i] + 1), total) for i in np.flatnonzero(wanted[rows[0]])]
                for key, value in adds:
                    if key in sums:
                        sums[key] += value
                    else:
                        sums[key] = value.copy()
                        cells += len(value)
            if cells > MAX_CELLS:
                yield from emit(sums)
                sums, cells = {}, 0
        yield from emit(sums)

    return run


def packed_sums(rows: DataFrame, d: int, m: int = 0, gaps: Mapping[int, bool] | None = None) -> DataFrame:
    """(__gid, part, cells) for ``rows`` (__gid, x: array of d, y: array of m, null where missing), centred.

    A task hands on one array per group and part. The salt is the square root of the most arrays a group has, so
    neither step gathers more than that many.
    """
    fields = [GROUP_ID, "x", *(["y"] if m else [])]
    partial = cut_lineage(rows.select(*fields).mapInArrow(_packed_sums(d, m, gaps or {}), PARTIAL), "gram-partial")
    most = partial.groupBy(GROUP_ID, "part").count().agg(F.max("count")).first()[0] or 1
    salts = int(np.ceil(np.sqrt(most)))

    def added(df: DataFrame, *by: str) -> DataFrame:
        every = F.collect_list("cells")
        total = F.aggregate(F.slice(every, 2, F.greatest(F.size(every) - 1, F.lit(0))), F.get(every, F.lit(0)), lambda a, c: F.zip_with(a, c, lambda p, q: p + q))
        return df.groupBy(*by).agg(total.alias("cells"))

    salted = partial.withColumn("salt", (F.rand(7) * salts).cast("int")) if salts > 1 else partial.withColumn("salt", F.lit(0))
    return added(added(salted, GROUP_ID, "part", "salt"), GROUP_ID, "part")


def group_packed(vectors: DataFrame, group: Sequence[str], vector: str, d: int) -> tuple[DataFrame, DataFrame]:
    """(groups with __gid, mean and n; packed sums of their centred vectors) for rows of ``d`` numbers each."""
    facts = vector_means(vectors, group, vector)
    facts = cut_lineage(facts.withColumn(GROUP_ID, F.monotonically_increasing_id()), "gram-groups")
    rows = join_on(vectors, facts, list(group)) if group else with_row(vectors, facts)
    centred = F.zip_with(F.col(vector), F.col("mean"), lambda x, m: x.cast("double") - m)
    return facts, packed_sums(rows.select(GROUP_ID, centred.alias("x")), d)


def block_similarity(
    df: DataFrame, x_cols: Sequence[str], y_cols: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Linear similarity of two column blocks over the same rows, overall or per group.

    Null for fewer than two complete rows or a block without variance.
    """
    both = [*x_cols, *y_cols]
    group = list(group)
    merged = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_merged"))
    d, left = len(both), len(x_cols)
    # one array from here on: many columns named one by one above a filter on all of them make planning explode
    full = complete_rows(df, both).select(*group, F.array(*[F.col(f"`{c}`").cast("double") for c in both]).alias("__v"))
    means = F.array(*[F.avg(F.get("__v", F.lit(i))) for i in range(d)])
    facts = full.groupBy(*group).agg(F.count(F.lit(1)).alias("n_samples"), means.alias("mean"))
    facts = cut_lineage(facts.withColumn(GROUP_ID, F.monotonically_increasing_id()), "gram-groups")
    rows = join_on(full, facts, group) if group else with_row(full, facts)
    sums = packed_sums(rows.select(GROUP_ID, F.zip_with("__v", "mean", lambda x, m: x - m).alias("x")), d)

    @F.pandas_udf("double")
    def score(cells: pd.Series) -> pd.Series:
        out = []
        for flat in cells:
            a = unpacked(np.asarray(flat, dtype=float), d)
            under = np.sqrt((a[:left, :left] ** 2).sum()) * np.sqrt((a[left:, left:] ** 2).sum())
            out.append((a[:left, left:] ** 2).sum() / under if under else None)
        return pd.Series(out, dtype=float)

    scored = sums.select(F.col(GROUP_ID).alias("__of"), score("cells").alias("__cka"))
    named = facts.join(scored, F.col(GROUP_ID) == F.col("__of"), "left").select(*group, "n_samples", F.nanvl("__cka", F.lit(None)).alias("__cka"))
    out = join_on(merged, named, group, "left") if group else with_row(merged, named)
    return out.select(
        *group,
        "n_merged",
        F.coalesce("n_samples", F.lit(0).cast("long")).alias("n_samples"),
        F.when(F.col("n_samples") >= 2, F.col("__cka")).alias("cka"),
    )


def _column_scores(d: int, m: int, gaps: Mapping[int, bool]):
    """Rows (__gid, k, num, xx, yy) of a group's packed sums; ``n`` holds each column's rows."""
    upper = np.triu_indices(d)
    weight = np.where(upper[0] == upper[1], 1.0, 2.0)
    size = triangle(d)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for gid, parts, n in zip(frame[GROUP_ID], frame["parts"], frame["n"], strict=True):
                by = {int(p["part"]): np.asarray(p["cells"], dtype=float) for p in parts}
                base = by[0]
                xy, yy = base[size : size + d * m].reshape(m, d), base[size + d * m :]
                for k in range(m):
                    square, x = base[:size], np.zeros(d)
                    if k in gaps and n[k]:
                        part = by.get(k + 1, np.zeros(size + d))
                        square = square - part[:size] if gaps[k] else part[:size]
                        x = -part[size:] if gaps[k] else part[size:]
                        square = square - np.outer(x, x)[upper] / n[k]
                    out.append((gid, k, float((xy[k] ** 2).sum()), float(np.sqrt((weight * square**2).sum())), float(yy[k])))
            yield pd.DataFrame(out, columns=["of", "k", "num", "xx", "yy"])

    return run


def feature_similarity(
    df: DataFrame,
    x_cols: Sequence[str],
    y_cols: Sequence[str],
    group: Sequence[str] = (),
    *,
    min_rows: int = 1,
) -> DataFrame:
    """Linear similarity of the block ``x_cols`` to each single column of ``y_cols``.

    Also the column's variance, share of zeros and whether it is constant; constant columns score 0.
    Rows without a complete block are dropped for all, rows without a value only for the column that lacks
    it. One aggregate takes the means, counts and variances of all columns, one pass the products; a column
    without any value has no row.
    """
    group, names, d, m = list(group), list(y_cols), len(x_cols), len(y_cols)
    numbers = [F.col(f"`{c}`").cast("double") for c in names]
    arrays = [F.array(*[F.col(f"`{c}`").cast("double") for c in x_cols]).alias("__x")]
    arrays.append(F.array(*[F.when(F.isnan(y), None).otherwise(y) for y in numbers]).alias("__y"))
    full = complete_rows(df, x_cols).select(*group, *arrays)
    ys = [F.get("__y", F.lit(k)) for k in range(m)]
    facts = full.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.avg(F.get("__x", F.lit(i))) for i in range(d)]).alias("x_mean"),
        F.array(*[F.avg(y) for y in ys]).alias("y_mean"),
        F.array(*[F.count(y) for y in ys]).alias("n"),
        F.array(*[F.var_pop(y) for y in ys]).alias("var"),
        F.array(*[F.avg((y == 0).cast("double")) for y in ys]).alias("zero"),
    )
    facts = cut_lineage(facts.withColumn(GROUP_ID, F.monotonically_increasing_id()), "gram-groups")
    totals = facts.agg(F.sum("rows"), *[F.sum(F.get("n", F.lit(k))) for k in range(m)]).first()
    every = totals[0] or 0
    # of a column with gaps the smaller side is added up: rows that lack it, or rows that have it
    gaps = {k: 2 * c >= every for k, c in enumerate(totals[1:]) if (c or 0) < every}
    means = facts.select(*group, GROUP_ID, "x_mean", "y_mean")
    rows = join_on(full, means, group) if group else with_row(full, means)
    x = F.zip_with("__x", "x_mean", lambda v, a: v - a)
    y = F.zip_with("__y", "y_mean", lambda v, a: v - a)
    sums = packed_sums(rows.select(GROUP_ID, x.alias("x"), y.alias("y")), d, m, gaps)
    parts = sums.groupBy(F.col(GROUP_ID).alias("of")).agg(F.collect_list(F.struct("part", "cells")).alias("parts"))  # m + 1 at most
    held = facts.select(GROUP_ID, "n").join(parts, F.col(GROUP_ID) == F.col("of")).select(GROUP_ID, "parts", "n")
    scores = held.mapInPandas(_column_scores(d, m, gaps), "of long, k int, num double, xx double, yy double")
    cells = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), "n", "var", "zero")
    long = facts.select(*group, GROUP_ID, F.posexplode(cells).alias("at", "c")).select(
        *group, GROUP_ID, "at", F.col("c.feature").alias("feature"), F.col("c.n").alias("n"), F.col("c.var").alias("var"), F.col("c.zero").alias("frac_zero")
    )
    out = long.join(scores, (F.col(GROUP_ID) == F.col("of")) & (F.col("at") == F.col("k")))
    constant = F.isnan("var") | (F.col("var") <= 1e-12)
    score = F.coalesce(F.col("num") / F.nullif(F.col("xx") * F.col("yy"), F.lit(0.0)), F.lit(0.0))
    return out.filter(F.col("n") >= max(1, min_rows)).select(
        *group,
        "feature",
        F.when(constant, F.lit(0.0)).otherwise(score).alias("cka_to_embedding"),
        "var",
        "frac_zero",
        constant.alias("is_constant"),
        "n",
    )


# ---- geometry of vectors ------------------------------------------------------------------


def unit_rows(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows without NaN scaled to length 1; a zero row stays zero."""
    kept = vectors.filter(~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return kept.withColumn(
        vector,
        let(
            F.when(norm == 0.0, F.lit(1.0)).otherwise(norm),
            lambda n: F.transform(vector, lambda x: x.cast("double") / n),
        ),
    )


def direction_stats(vectors: DataFrame, group: Sequence[str], vector: str, power: int = 1) -> DataFrame:
    """Mean pairwise cosine and dominant dimension per group, from per-dimension sums only.

    ``power`` 1 weighs dimensions by mean |u|, 2 by mean u squared. Fewer than two rows: null and -1.
    """
    unit = unit_rows(vectors, vector)
    dims = unit.select(*group, F.posexplode(vector).alias("dim", "u"))
    weight = F.abs(F.col("u")) if power == 1 else F.col("u") * F.col("u")
    sums = dims.groupBy(*group, "dim").agg(
        F.sum("u").alias("su"), F.avg(weight).alias("w"), F.count(F.lit(1)).alias("n")
    )
    out = sums.groupBy(*group).agg(
        F.max("n").alias("n_samples"),
        F.count(F.lit(1)).alias("n_dims"),
        F.sum(F.col("su") * F.col("su")).alias("__ss"),
        F.max("w").alias("__w"),
        F.max_by("dim", F.struct(F.col("w"), -F.col("dim"))).alias("__d"),
    )
    n = F.col("n_samples").cast("double")
    enough = F.col("n_samples") >= 2
    return out.select(
        *group,
        "n_samples",
        F.col("n_dims").cast("int").alias("n_dims"),
        F.when(enough, (F.col("__ss") - n) / F.nullif(n * (n - 1), F.lit(0.0))).alias("mean_pairwise_cosine"),
        F.when(enough, F.col("__w")).alias("dominant_weight"),
        F.when(enough, F.col("__d")).otherwise(F.lit(-1)).alias("dominant_dim"),
    )


def _eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return np.clip(values[::-1], 0.0, None), vectors[:, ::-1]


def spectrum_stats(vectors: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Share of the first component and normalised effective rank per group.

    Only the summed d x d matrix of a group reaches the eigenvalue step.
    """
    group = list(group)
    kept = vectors.filter(~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    first = kept.select(F.size(vector)).first()
    d = first[0] if first else 0
    facts, sums = group_packed(kept, group, vector, d)

    @F.pandas_udf("top double, rank double")
    def reduce(cells: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for flat, size in zip(cells, n, strict=True):
            lam, _ = _eigen(unpacked(np.asarray(flat, dtype=float), d))
            total = lam.sum()
            if size < 2 or total <= 0:
                rows.append((None, None))
                continue
            p = np.clip(lam[: int(min(size, d))] / total, 1e-12, None)
            rows.append((lam[0] / total, float(np.exp(-(p * np.log(p)).sum()) / min(size, d))))
        return pd.DataFrame(rows, columns=["top", "rank"]).astype(float)

    joined = facts.join(sums.withColumnRenamed(GROUP_ID, "__of"), F.col(GROUP_ID) == F.col("__of"))
    return joined.withColumn("__r", reduce("cells", "n")).select(
        *group,
        F.col("n").alias("n_samples"),
        F.col("__r.top").alias("top_variance_ratio"),
        F.col("__r.rank").alias("effective_rank_norm"),
    )


def first_component(vectors: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and first principal direction of a table of vectors (2 x d numbers reach the driver)."""
    kept = vectors.filter(~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))
    d = kept.select(F.size(vector)).first()[0]
    facts, sums = group_packed(kept, [], vector, d)
    mean = facts.select("mean").first()[0]
    _, vec = _eigen(unpacked(np.asarray(sums.select("cells").first()[0], dtype=float), d))
    lead = vec[:, 0]
    return [float(m) for m in mean], [float(x) for x in lead * np.sign(lead[np.argmax(np.abs(lead))])]


def pearson(x: str, y: str) -> Column:
    """Correlation, null where a side has no spread."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def component_alignment(
    df: DataFrame, vector: str, features: Sequence[str], ids: Sequence[str], min_rows: int = 3
) -> DataFrame:
    """|correlation| of each feature with the first-component score, over rows where both are finite."""
    mean, lead = first_component(df, vector)
    shifted = F.zip_with(F.col(vector), lit_array(mean), lambda x, m: x.cast("double") - m)
    scored = df.withColumn("__pc", dot(shifted, lit_array(lead)))
    long = to_long(scored, [*ids, "__pc"], features)
    pairs = long.withColumn("value", finite(F.col("value"))).filter(
        F.col("value").isNotNull() & finite(F.col("__pc")).isNotNull()
    )
    agg = pairs.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        pearson("__pc", "value").alias("__c"),
        F.stddev_pop("value").alias("__sd"),
    )
    usable = (F.col("n") >= min_rows) & (F.col("__sd") > 0)
    return agg.select("feature", "n", F.when(usable, F.abs("__c")).alias("abs_corr"))


def correlation_filter(
    aligned: DataFrame, top_k: int | None = None, at_least: float | None = None
) -> DataFrame:
    """Features by |correlation| (then rows, then name): the best ``top_k`` and/or those over a bound."""
    out = aligned.filter(F.col("abs_corr").isNotNull())
    if at_least is not None:
        out = out.filter(F.col("abs_corr") >= at_least)
    order = [F.col("abs_corr").desc(), F.col("n").desc(), F.col("feature")]
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)
