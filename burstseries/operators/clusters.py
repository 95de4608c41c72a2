"""Clustering of representation tables and figures about the clusters."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstseries.functions.arrays import l2_unit
from burstseries.functions.hashing import hash32
from burstseries.functions.ordered import join_on, with_row
from burstseries.operators.explain import cluster_stats
from burstseries.operators.gram import cross_products
from burstseries.session import cut_lineage


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def distinct_vectors(df: DataFrame, vector: str, decimals: int | None = None) -> DataFrame:
    """Rows and distinct rows (optionally after rounding) of a vector column."""
    v = F.col(vector) if decimals is None else F.transform(vector, lambda x: F.round(x.cast("double"), decimals))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(v).alias("n_distinct"))


# ---- k-means ------------------------------------------------------------------------------


def _vectors(df: DataFrame, ids: Sequence[str], vector: str) -> DataFrame:
    return df.select(*ids, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def kmeans_labels(
    df: DataFrame,
    ids: Sequence[str],
    vector: str,
    k: int,
    *,
    seed: int = 42,
    n_init: int = 10,
    max_iter: int = 100,
    init_steps: int = 2,
) -> DataFrame:
    """Labels of the best of ``n_init`` seeded runs (lowest cost); 2 <= k < rows.

    The vectors are stored once and every run reads them; the model is k centres.
    """
    data = cut_lineage(_vectors(df, ids, vector), "vectors")
    rows = data.count()
    if not 2 <= k < rows:
        raise ValueError(f"k must lie in [2, {rows - 1}], not {k}")
    best = None
    for run in range(n_init):
        model = KMeans(k=k, seed=seed + run, maxIter=max_iter, initSteps=init_steps).fit(data)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    out = best.transform(data).withColumnRenamed("prediction", "label")
    return out.select(*ids, "label")


def cosine_kmeans_labels(df: DataFrame, ids: Sequence[str], vector: str, k: int, **kw) -> DataFrame:
    """K-means on rows scaled to length 1."""
    return kmeans_labels(df.select(*ids, l2_unit(vector).alias(vector)), ids, vector, k, **kw)


def row_norm(vector: str):
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    clean = F.when(F.isnan(norm), 0.0).otherwise(norm)
    return F.least(F.greatest(F.coalesce(clean, F.lit(0.0)), F.lit(0.0)), F.lit(1e12))


def norm_kmeans_labels(df: DataFrame, ids: Sequence[str], vector: str, k: int, **kw) -> DataFrame:
    """K-means on the rows' lengths alone."""
    return kmeans_labels(df.select(*ids, F.array(row_norm(vector)).alias(vector)), ids, vector, k, **kw)


def sweep_labels(
    df: DataFrame,
    ids: Sequence[str],
    vector: str,
    ks: Iterable[int],
    seeds: Iterable[int],
    path: str,
    runs: int = 1,
    n_init: int = 1,
    max_iter: int = 100,
) -> DataFrame:
    """Labels of every (k, run, seed), written as partitions below ``path`` and read back.

    Each grid point is one distributed fit; the driver only steps through the grid.
    """
    source = cut_lineage(df.select(*ids, vector), "sweep-input")
    for k, run, seed in itertools.product(ks, range(runs), seeds):
        got = kmeans_labels(source, ids, vector, k, seed=seed + 1000 * run, n_init=n_init, max_iter=max_iter)
        got.write.mode("overwrite").parquet(f"{path.rstrip('/')}/k={k}/run={run}/seed={seed}")
    return df.sparkSession.read.option("basePath", path).parquet(path)


# ---- density clustering -------------------------------------------------------------------

NOISE = -1


def _cells(points: DataFrame, eps: float, block_rows: int) -> DataFrame:
    """Every point once per block pair it must be compared in.

    Points within ``eps`` differ by at most ``eps`` in distance to the pivot, so only slabs of that
    distance that touch need comparing. A slab is cut into blocks of about ``block_rows`` points,
    however full it is; a block pair is one bounded unit of work.
    """
    slab = F.floor(F.col("__key") / F.lit(float(eps))).cast("long")
    placed = points.withColumn("slab", slab)
    sizes = placed.groupBy("slab").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("nb"))
    up = sizes.select((F.col("slab") - 1).alias("slab"), F.col("nb").alias("nb_up"))
    down = sizes.select((F.col("slab") + 1).alias("slab"), F.col("nb").alias("nb_down"))
    near = join_on(join_on(join_on(placed, sizes, ["slab"]), up, ["slab"], "left"), down, ["slab"], "left")
    block = F.pmod(hash32(["id"]), F.col("nb")).cast("int")
    near = near.withColumn("block", block)

    def pairs(other_slab, count):
        return F.transform(
            F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
            lambda b: F.struct(other_slab.alias("slab"), b.alias("block")),
        )

    slab_c, zero = F.col("slab"), F.lit(0)
    others = F.concat(
        pairs(slab_c, F.col("nb")),
        pairs(slab_c + 1, F.coalesce("nb_up", zero)),
        pairs(slab_c - 1, F.coalesce("nb_down", zero)),
    )
    each = near.select("id", "v", "w", "slab", "block", F.explode(others).alias("o"))
    mine, other = F.struct("slab", "block"), F.col("o")
    return each.withColumns({"lo": F.least(mine, other), "hi": F.greatest(mine, other)}).withColumn(
        "first", F.struct("slab", "block") == F.col("lo")
    )


STRIPE = 128  # rows of a block pair whose distances are held at once


class _Near:
    """Which rows of a block pair lie within ``eps`` of some of its rows, never as a table of all pairs."""

    def __init__(self, vectors: pd.Series, eps: float):
        self.x = np.stack([np.asarray(v, dtype=float) for v in vectors])
        self.sq, self.eps = (self.x * self.x).sum(1), eps

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        d = self.sq[rows, None] + self.sq[None, :] - 2 * self.x[rows] @ self.x.T
        return np.sqrt(np.clip(d, 0, None)) <= self.eps

    def stripes(self, rows: np.ndarray):
        for start in range(0, len(rows), STRIPE):
            yield rows[start : start + STRIPE]


def density_labels(
    df: DataFrame,
    ids: Sequence[str],
    vector: str,
    *,
    eps: float,
    min_samples: int,
    block_rows: int = 2_000,
    max_rounds: int = 60,
) -> DataFrame:
    """Density clustering: core points have ``min_samples`` rows (themselves too) within ``eps``;
    linked core points form a cluster, points next to one join it, the rest is noise (-1).

    Equal vectors are one weighted point, so copies cost nothing. Block pairs return neighbour
    counts and a spanning forest of their links, never the list of pairs.
    """
    keyed = df.select(*ids, F.col(vector).cast("array<double>").alias("v")).withColumn(
        "id", F.md5(F.to_json("v"))
    )
    stored = cut_lineage(keyed, "points")
    unique = stored.groupBy("id").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).alias("w"))
    dims = unique.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    center = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda c: c["m"]).alias("__c"))
    gap = F.zip_with(F.col("v"), F.col("__c"), lambda a, b: (a - b) * (a - b))
    points = with_row(unique, center).select(
        "id", "v", "w", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)).alias("__key")
    )
    cells = cut_lineage(_cells(points, eps, block_rows), "cells")

    def count(part: pd.DataFrame) -> pd.DataFrame:
        near, first, w = _Near(part["v"], eps), part["first"].to_numpy(), part["w"].to_numpy()
        inside = part["lo"].iloc[0] == part["hi"].iloc[0]
        c = np.zeros(len(part), dtype=np.int64)
        for rows in near.stripes(np.arange(len(part))):
            some = near(rows)
            if not inside:
                some &= first[rows, None] != first[None, :]
            c[rows] = some @ w
        return pd.DataFrame({"id": part["id"], "c": c})

    counts = cells.groupBy("lo", "hi").applyInPandas(count, "id string, c long")
    core = counts.groupBy("id").agg((F.sum("c") >= min_samples).alias("core"))
    known = cut_lineage(join_on(cells, core, ["id"]), "core-cells")

    def links(part: pd.DataFrame) -> pd.DataFrame:
        near, is_core, name = _Near(part["v"], eps), part["core"].to_numpy(dtype=bool), part["id"].to_numpy()
        at = np.flatnonzero(is_core)
        at = at[np.argsort(name[at])]
        seen = np.zeros(len(part), dtype=bool)
        rows = []
        for start in at:
            if seen[start]:
                continue
            seen[start] = True
            frontier = np.array([start])
            while len(frontier):
                rows += [(name[i], name[start], True) for i in frontier]
                beside = np.zeros(len(part), dtype=bool)
                for some in near.stripes(frontier):
                    beside |= near(some).any(0)
                frontier = np.flatnonzero(beside & is_core & ~seen)
                seen[frontier] = True
        for some in near.stripes(np.flatnonzero(~is_core)):
            for i, row in zip(some, near(some)[:, at], strict=True):
                if row.any():
                    rows.append((name[i], name[at[row.argmax()]], False))
        return pd.DataFrame(rows, columns=["id", "to", "core"])

    edges = cut_lineage(
        known.groupBy("lo", "hi").applyInPandas(links, "id string, to string, core boolean").distinct(), "links"
    )
    components = connected_components(edges.filter("core").select("id", "to"), max_rounds)
    border = edges.filter(~F.col("core")).groupBy("id").agg(F.min("to").alias("to"))
    border = border.join(components.withColumnRenamed("id", "to"), "to").select("id", "component")
    labels = components.unionByName(border)
    # cluster numbers in the order of the component names; one row per cluster is numbered

    numbers = labels.select("component").distinct().withColumn(
        "label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("component")) - 1
    )
    by_point = join_on(labels, numbers, ["component"]).select("id", "label")
    return join_on(stored, by_point, ["id"], "left").select(
        *ids, F.coalesce("label", F.lit(NOISE)).alias("label")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` with the smallest reachable id, by alternating star contraction.

    Each round relinks neighbours to their smallest neighbour; the number of rounds grows with the
    logarithm of the longest chain. Rounds are stored in the shared folder.
    """
    both = edges.select(F.col("id").alias("a"), F.col("to").alias("b"))
    current = cut_lineage(both.filter(F.col("a") != F.col("b")).distinct(), "edges")
    nodes = cut_lineage(both.select("a").union(both.select("b")).distinct(), "nodes")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        sym = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = join_on(sym, low, ["a"])
        if large:
            return linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select("a", F.col("m").alias("b"))
        return down.union(own).filter(F.col("a") != F.col("b")).distinct()

    for _ in range(max_rounds):
        nxt = cut_lineage(star(star(current, True), False), "edges")
        changed = not nxt.exceptAll(current).isEmpty() or not current.exceptAll(nxt).isEmpty()
        current = nxt
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.groupBy("a").agg(F.min("b").alias("component"))
    return join_on(nodes, roots, ["a"], "left").select(
        F.col("a").alias("id"), F.coalesce("component", F.col("a")).alias("component")
    )


# ---- cluster quality ----------------------------------------------------------------------


def quality_scores(long: DataFrame, row_key: Sequence[str], min_cluster_size: int = 2) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from cluster sums; a reason where they cannot be given.

    ``long`` is ``(cluster_id, row_key, feature, value)`` with no missing values. Distances between
    centres come from one cross-product pass over the features, not from a join of centre pairs.
    """
    stats = cluster_stats(long)
    sizes = stats.groupBy("cluster_id").agg(F.max("n_members").alias("n_members"))
    valid = sizes.filter(F.col("n_members") >= min_cluster_size)
    stats = join_on(stats.drop("n_members"), valid, ["cluster_id"])
    totals = stats.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__m"))
    parts = join_on(stats, totals, ["feature"]).agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("__m")) * (F.col("mean") - F.col("__m"))).alias("ssb"),
        F.sum(F.col("n") * F.col("var_all")).alias("ssw"),
    )
    counts = valid.agg(F.count(F.lit(1)).alias("k"), F.sum("n_members").alias("n_samples"))

    gaps = join_on(long, stats.select("cluster_id", "feature", "mean"), ["cluster_id", "feature"])
    sq = (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))
    dist = gaps.groupBy("cluster_id", *row_key).agg(F.sqrt(F.sum(sq)).alias("__d"))
    spread = dist.groupBy("cluster_id").agg(F.avg("__d").alias("s"))


    numbered = spread.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster_id")) - 1)
    centers = join_on(stats, numbered.select("cluster_id", "i"), ["cluster_id"])
    shifted = join_on(centers, totals, ["feature"]).withColumn("c", F.col("mean") - F.col("__m"))
    per_feature = shifted.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("v")
    )
    g = cross_products(per_feature, [], "v")
    own = g.filter(F.col("i") == F.col("j")).select("i", F.col("s").alias("own"))
    a = numbered.select("i", F.col("s").alias("si"))
    cross = g.filter(F.col("i") != F.col("j"))
    cross = join_on(cross.withColumnRenamed("s", "g"), join_on(a, own, ["i"]), ["i"])
    right = join_on(a, own, ["i"]).select(F.col("i").alias("j"), F.col("si").alias("sj"), F.col("own").alias("own_j"))
    cross = join_on(cross, right, ["j"])
    d = F.sqrt(F.greatest(F.col("own") + F.col("own_j") - 2 * F.col("g"), F.lit(0.0)))
    ratio = (F.col("si") + F.col("sj")) / F.nullif(d, F.lit(0.0))
    worst = cross.groupBy("i").agg(F.max(F.coalesce(ratio, F.lit(0.0))).alias("r"))
    db = worst.agg(F.avg("r").alias("davies_bouldin"))

    k, n = F.col("k"), F.col("n_samples")
    ch = F.when(F.col("ssw") == 0, F.lit(1.0)).otherwise(
        F.col("ssb") * (n - k) / F.nullif(F.col("ssw") * (k - 1), F.lit(0.0))
    )
    reason = (
        F.when(k < 2, "need_at_least_two_clusters_with_min_size")
        .when(n < 2, "too_few_finite_rows")
        .otherwise(F.lit("ok"))
    )
    out = with_row(with_row(counts, parts), db)
    ok = reason == "ok"
    return out.select(
        F.when(ok, ch).alias("calinski_harabasz"),
        F.when(ok, F.col("davies_bouldin")).alias("davies_bouldin"),
        reason.alias("status"),
        F.col("k").alias("n_clusters"),
        F.coalesce("n_samples", F.lit(0).cast("long")).alias("n_samples"),
    )
