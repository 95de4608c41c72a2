"""What sets clusters apart: variance ratios, effect sizes, rankings and the tables built from them.

Input is the long form ``(cluster_id, ..., feature, value)``; one combining aggregate per (cluster,
feature) touches the rows, everything after works on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstseries.functions.ordered import join_on, with_row
from burstseries.operators.order_stats import column_medians

EPS = 1e-12


def cluster_stats(long: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Per cluster and feature: members (rows), present values, mean, variance (null under two values)."""
    v = F.col("value")
    out = long.groupBy(F.col(cluster).alias("cluster_id"), "feature").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("var_all"),
    )
    return out.withColumn("var", F.when(F.col("n") >= 2, F.col("var_all")))


def value_summary(long: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Count, mean, sample deviation and range per cluster and feature."""
    v = F.col("value")
    return long.groupBy(F.col(cluster).alias("cluster_id"), "feature").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.when(F.count(v) >= 2, F.stddev_samp(v)).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def invariance_scores(stats: DataFrame, min_cluster_size: int = 5, min_var_n: int = 2) -> DataFrame:
    """Spread inside and between clusters per feature, over clusters of enough members.

    Totals come from the clusters' own means and variances (law of total variance), so the rows are
    not read again.
    """
    valid = stats.filter(F.col("n_members") >= min_cluster_size)
    sizes = valid.select("cluster_id", "n_members").distinct().agg(
        F.sum("n_members").alias("__rows"), F.count(F.lit(1)).alias("clusters_used")
    )
    w = Window.partitionBy("feature")
    n = F.col("n")
    total_n = F.sum("n").over(w)
    total_mean = F.sum(n * F.col("mean")).over(w) / F.nullif(total_n, F.lit(0))
    base = with_row(valid, sizes).withColumns({"__tn": total_n, "__tm": total_mean})
    used = F.col("n") >= min_var_n
    cv = F.sqrt("var_all") / (F.abs("mean") + EPS)
    gap = F.col("mean") - F.col("__tm")
    per = base.groupBy("feature").agg(
        F.max("__tn").alias("__tn"),
        F.max("__tm").alias("total_mean"),
        (F.sum(n * (F.col("var_all") + gap * gap)) / F.nullif(F.max("__tn"), F.lit(0))).alias("total_var"),
        F.avg(F.when(used, F.col("var_all"))).alias("within_var_mean"),
        F.avg(F.when(used, cv)).alias("within_cv_mean"),
        F.sum(F.when(used, F.col("n_members") / F.col("__rows") * F.col("var_all"))).alias("within_var_weighted"),
        F.var_pop(F.when(used, F.col("mean"))).alias("between_var"),
        F.max("clusters_used").alias("clusters_used"),
    )
    per = per.filter((F.col("__tn") >= 2) & F.col("within_var_mean").isNotNull())
    tv = F.col("total_var") + EPS
    return per.select(
        "feature",
        "total_mean",
        "total_var",
        "within_var_mean",
        "within_cv_mean",
        "within_var_weighted",
        "between_var",
        (F.col("within_var_weighted") / tv).alias("w_over_t"),
        (F.col("between_var") / tv).alias("eta2"),
        (F.col("between_var") / (F.col("within_var_mean") + EPS)).alias("fisher_ratio"),
        "clusters_used",
    )


def global_fisher(stats: DataFrame) -> DataFrame:
    """Between over within variance with every cluster counted; a single member has variance 0."""
    has = F.col("n") >= 1
    per = stats.groupBy("feature").agg(
        F.when(F.count(F.lit(1)) == F.count("mean"), F.var_pop("mean")).alias("between_var"),
        F.avg(F.when(has, F.col("var_all"))).alias("within_var_mean"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count(F.when(has, F.col("var_all"))).alias("n_groups_with_var"),
    )
    return per.withColumn("fisher_ratio", F.col("between_var") / (F.col("within_var_mean") + EPS))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def fisher_select(scores: DataFrame, at_least: float = 0.1) -> DataFrame:
    """Features whose ratio reaches the bound, best first, with their rank."""
    return fisher_order(scores.filter(F.col("fisher_ratio") >= at_least))


def fisher_order(scores: DataFrame) -> DataFrame:
    """Rank features by ratio, then by name. The table has one row per feature."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("fisher_ratio").desc_nulls_last(), "feature")
    return scores.withColumn("fisher_rank", F.row_number().over(w))


def population_stats(stats: DataFrame) -> DataFrame:
    """Member-weighted mean and variance per feature and the unweighted variance ratio."""
    w = Window.partitionBy("feature")
    weight = F.col("n_members").cast("double")
    base = stats.withColumn("__w", F.sum(weight).over(w)).withColumn(
        "__m", F.sum(weight * F.col("mean")).over(w) / F.col("__w")
    )
    gap = F.col("mean") - F.col("__m")
    per = base.groupBy("feature").agg(
        F.max("__m").alias("mean_pop"),
        (F.sum(weight * (F.col("var") + gap * gap)) / F.max("__w")).alias("var_pop"),
        (F.var_pop("mean") / (F.avg("var") + EPS)).alias("fisher_ratio"),
    )
    return fisher_order(per.withColumn("std_pop", F.sqrt("var_pop")))


def top_variance(pop: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` features of largest population variance, ties in ratio order."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("var_pop").desc(), "fisher_rank")
    return pop.select(
        F.row_number().over(w).alias("rank"), "feature", "var_pop", "std_pop", "fisher_ratio"
    ).filter(F.col("rank") <= n)


def cohens_d(stats: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Effect size of each cluster against the size-weighted mean of all the others.

    The divisor is the cluster's deviation, but at least ``eps * (1 + |rest mean|)``. What cannot be
    computed is 0.
    """
    w = Window.partitionBy("feature")
    weight = F.greatest(F.col("n_members").cast("double"), F.lit(1.0))
    base = stats.withColumns(
        {
            "__n": weight,
            "__nm": F.sum(weight * F.col("mean")).over(w),
            "__total": F.sum(weight).over(w),
            "__gaps": F.sum(F.col("mean").isNull().cast("int")).over(w),
        }
    )
    rest = (F.col("__nm") - F.col("__n") * F.col("mean")) / F.greatest(F.col("__total") - F.col("__n"), F.lit(1.0))
    spread = F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))
    floor = eps * (1.0 + F.abs("mean_rest"))
    out = base.withColumn("mean_rest", rest).withColumn("__den", F.greatest(spread, floor))
    bad = (F.col("__gaps") > 0) | F.col("var").isNull() | F.col("mean").isNull()
    d = F.when(bad, F.lit(0.0)).otherwise((F.col("mean") - F.col("mean_rest")) / F.col("__den"))
    return out.select("cluster_id", "feature", "n_members", "mean", "var", d.alias("cohens_d")).withColumn(
        "abs_cohens_d", F.abs("cohens_d")
    )


def wide_to_long(wide: DataFrame, value: str = "cohens_d") -> DataFrame:
    """A feature x cluster table as rows, with the absolute value."""
    clusters = [c for c in wide.columns if c != "feature"]
    long = wide.unpivot(["feature"], [F.col(f"`{c}`") for c in clusters], "cluster_id", value)
    return long.withColumn(f"abs_{value}", F.abs(value))


def long_to_wide(long: DataFrame, value: str, clusters: Sequence | None = None) -> DataFrame:
    """One row per feature, one column per cluster."""
    grouped = long.groupBy("feature")
    return (grouped.pivot("cluster_id", list(clusters)) if clusters else grouped.pivot("cluster_id")).agg(F.first(value))


def variance_rank(stats: DataFrame, truncate: bool = False) -> DataFrame:
    """Average rank of features by variance inside each cluster, missing ones last."""
    order = Window.partitionBy("cluster_id").orderBy(F.col("var").asc_nulls_last())
    ties = Window.partitionBy("cluster_id", "var")
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return stats.withColumn("variance_rank", F.floor(rank).cast("int") if truncate else rank.cast("double"))


def rank_export(stats: DataFrame) -> DataFrame:
    """One JSON text per cluster: members and, per feature, rank, mean and variance."""
    ranked = variance_rank(stats, truncate=True)
    cell = F.struct(
        "feature", F.struct(F.col("variance_rank").alias("rank"), "mean", F.col("var").alias("var")).alias("figures")
    )
    return ranked.groupBy("cluster_id").agg(
        F.max("n_members").alias("n_members"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(cell)))).alias("features"),
    )


def lowest_norm_variance(stats: DataFrame, pop: DataFrame, n: int) -> DataFrame:
    """Per cluster the ``n`` features whose variance is smallest against the population's."""
    joined = join_on(stats, pop.select("feature", "var_pop", "fisher_rank"), ["feature"])
    ratio = F.col("var") / F.nullif(F.col("var_pop"), F.lit(0.0))
    w = Window.partitionBy("cluster_id").orderBy("norm_var", "fisher_rank")
    return (
        joined.withColumn("norm_var", ratio)
        .filter(F.col("norm_var").isNotNull())
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
        .select("cluster_id", "rank", "feature", "var", "var_pop", "norm_var")
    )


def cluster_extremes(effects: DataFrame, pop: DataFrame) -> DataFrame:
    """Per cluster the features at the smallest and largest effect and variance, first in ratio order."""
    rows = join_on(effects, pop.select("feature", "var_pop", "fisher_rank"), ["feature"])
    pack = F.struct("feature", "cohens_d", "var", "var_pop")
    tie = F.col("fisher_rank")
    has_v = F.col("var").isNotNull()
    out = rows.groupBy("cluster_id").agg(
        F.max("n_members").alias("n_members"),
        F.min_by(pack, F.struct(F.col("cohens_d"), tie)).alias("dmin"),
        F.max_by(pack, F.struct(F.col("cohens_d"), -tie)).alias("dmax"),
        F.min_by(pack, F.when(has_v, F.struct(F.col("var"), tie))).alias("vmin"),
        F.max_by(pack, F.when(has_v, F.struct(F.col("var"), -tie))).alias("vmax"),
    )
    parts = []
    for end in ("dmin", "dmax", "vmin", "vmax"):
        for c in ("feature", "cohens_d", "var", "var_pop"):
            parts.append(F.col(f"{end}.{c}").alias(f"{end}_{c}"))
    return out.select("cluster_id", "n_members", *parts)


def extreme_rows(effects: DataFrame, pop: DataFrame, what: str, side: str) -> DataFrame:
    """One row per cluster with the feature at one extreme (``what`` is cohens_d or var, ``side`` min or max)."""
    end = {"cohens_d": "d", "var": "v"}[what] + side
    wide = cluster_extremes(effects, pop)
    return wide.select("cluster_id", *[F.col(f"{end}_{c}").alias(c) for c in ("feature", "cohens_d", "var", "var_pop")])


IMPORTANCE_ORDER = ("feature_importance", "norm_cka", "norm_cohen")


def importance_order() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in IMPORTANCE_ORDER] + [F.col("feature").asc()]


def _positive(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(F.lit(1.0))


def local_importance(cka: DataFrame, effects: DataFrame) -> DataFrame:
    """Similarity and effect size divided by their largest in the cluster, multiplied and ranked."""
    w = Window.partitionBy("cluster_id")
    joined = join_on(
        cka.select("cluster_id", "feature", "cka_to_embedding"),
        effects.select("cluster_id", "feature", "cohens_d", "abs_cohens_d"),
        ["cluster_id", "feature"],
        "left",
    )
    normed = joined.withColumns(
        {
            "norm_cka": F.col("cka_to_embedding") / _positive(F.max("cka_to_embedding").over(w)),
            "norm_cohen": F.col("abs_cohens_d") / _positive(F.max("abs_cohens_d").over(w)),
        }
    )
    scored = normed.withColumn("feature_importance", F.col("norm_cka") * F.col("norm_cohen"))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(*importance_order())))


def global_importance(cka: DataFrame, effects: DataFrame, floor: float = EPS) -> DataFrame:
    """As the local form, but divided by the largest values over all clusters and features."""
    top_cka = cka.agg(F.greatest(F.max("cka_to_embedding"), F.lit(floor)).alias("__gc"))
    top_d = effects.agg(F.greatest(F.max("abs_cohens_d"), F.lit(floor)).alias("__gd"))
    joined = join_on(
        cka.select("cluster_id", "feature", "cka_to_embedding"),
        effects.select("cluster_id", "feature", "cohens_d", "abs_cohens_d"),
        ["cluster_id", "feature"],
    )
    out = with_row(with_row(joined, top_cka), top_d).withColumns(
        {
            "norm_cka": F.col("cka_to_embedding") / F.col("__gc"),
            "norm_cohen": F.col("abs_cohens_d") / F.col("__gd"),
        }
    )
    return out.withColumn("feature_importance", F.col("norm_cka") * F.col("norm_cohen")).drop("__gc", "__gd")


def top_k_rows(importance: DataFrame, k: int) -> DataFrame:
    """The best ``k`` features per cluster."""
    w = Window.partitionBy("cluster_id").orderBy(*importance_order())
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cluster_importance(top: DataFrame) -> DataFrame:
    """Sum and number of the kept features per cluster."""
    return top.groupBy("cluster_id").agg(
        F.sum("feature_importance").alias("cluster_importance_topk_sum"),
        F.count("feature_importance").alias("n_top_features_used"),
    )


def rescale_effects(effects: DataFrame, mode: str = "none", d0: float | str | None = None) -> DataFrame:
    """``norm_cohen`` by mode: |d| as is, over one global maximum (at least 1e-3), or tanh(|d| / d0)."""
    a = F.col("abs_cohens_d")
    if mode == "none":
        return effects.withColumn("norm_cohen", a)
    if mode == "max":
        top = effects.agg(F.greatest(F.max(a), F.lit(1e-3)).alias("__g"))
        return with_row(effects, top).withColumn("norm_cohen", a / F.col("__g")).drop("__g")
    if mode != "tanh" or d0 is None:
        raise ValueError("mode is 'none', 'max' or 'tanh' (with d0)")
    if d0 == "median":
        mid = column_medians(effects, {"__m": "abs_cohens_d"})
        mid = mid.select(F.greatest(F.coalesce("__m", F.lit(1.0)), F.lit(1e-6)).alias("__g"))
        return with_row(effects, mid).withColumn("norm_cohen", F.tanh(a / F.col("__g"))).drop("__g")
    return effects.withColumn("norm_cohen", F.tanh(a / F.lit(max(float(d0), 1e-6))))


def fisher_cka_table(fisher: DataFrame, cka: DataFrame) -> DataFrame:
    """Both metrics per feature; a feature missing on one side stays."""
    return fisher.join(cka, on="feature", how="full_outer")


def filter_features(
    metrics: DataFrame,
    mode: str,
    *,
    top_k: int = 50,
    at_least: float = 0.1,
    precomputed: DataFrame | None = None,
) -> DataFrame:
    """Features kept for the overlay tables, with their rank.

    ``intersection``: among the ``top_k`` by similarity and over the ratio bound, in similarity order;
    ``fisher_min``: over the bound, in ratio order; ``precomputed``: a given list (``feature, pos``),
    first mention counts, those present kept.
    """
    one = Window.partitionBy(F.lit(0))
    if mode == "intersection":
        by_cka = one.orderBy(F.col("cka_to_embedding").desc_nulls_last(), "feature")
        best = metrics.withColumn("__k", F.row_number().over(by_cka)).filter(
            (F.col("__k") <= top_k) & (F.col("fisher_ratio") >= at_least)
        )
        return best.withColumn("rank", F.row_number().over(one.orderBy("__k"))).drop("__k")
    if mode == "fisher_min":
        order = one.orderBy(F.col("fisher_ratio").desc(), "feature")
        return metrics.filter(F.col("fisher_ratio") >= at_least).withColumn("rank", F.row_number().over(order))
    if mode != "precomputed" or precomputed is None:
        raise ValueError("mode is 'intersection', 'fisher_min' or 'precomputed' (with a list)")
    firsts = precomputed.groupBy("feature").agg(F.min("pos").alias("__p"))
    kept = metrics.join(firsts, "feature")
    return kept.withColumn("rank", F.row_number().over(one.orderBy("__p"))).drop("__p")


def ranking_rows(cka: DataFrame, effects: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """Per cluster the top ``k`` features by similarity and by |effect|, as one long table."""
    keep = features.select("feature", F.col("rank").alias("__o"))
    by = {
        "cka": join_on(cka.select("cluster_id", "feature", "cka_to_embedding"), keep, ["feature"]),
        "cohen_d": join_on(effects.select("cluster_id", "feature", "cohens_d", "abs_cohens_d"), keep, ["feature"]),
    }
    score = {"cka": F.col("cka_to_embedding").desc_nulls_last(), "cohen_d": F.col("abs_cohens_d").desc()}
    parts = []
    for kind, rows in by.items():
        w = Window.partitionBy("cluster_id").orderBy(score[kind], "__o")
        parts.append(
            rows.withColumns({"order_type": F.lit(kind), "rank": F.row_number().over(w)})
            .filter(F.col("rank") <= k)
            .drop("__o")
        )
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def overlay_importance(
    cka: DataFrame, effects: DataFrame, features: DataFrame, *, mode: str = "max", d0: float | str | None = None
) -> DataFrame:
    """Importance of the kept features in every cluster, ranked; missing effects count as 0."""
    keep = features.select("feature")
    near = cka.join(keep, "feature", "left_semi").select("cluster_id", "feature", "cka_to_embedding")
    top = near.agg(F.greatest(F.coalesce(F.max("cka_to_embedding"), F.lit(1.0)), F.lit(EPS)).alias("__g"))
    scaled = rescale_effects(effects, mode, d0).select("cluster_id", "feature", "cohens_d", "norm_cohen")
    joined = join_on(with_row(near, top), scaled, ["cluster_id", "feature"], "left")
    out = joined.withColumns(
        {
            "norm_cka": F.col("cka_to_embedding") / F.col("__g"),
            "norm_cohen": F.coalesce("norm_cohen", F.lit(0.0)),
        }
    ).withColumn("feature_importance", F.col("norm_cka") * F.col("norm_cohen"))
    w = Window.partitionBy("cluster_id").orderBy(*importance_order())
    return out.filter(F.col("feature_importance").isNotNull()).withColumn("rank", F.row_number().over(w)).drop("__g")


def with_cluster_mean(top: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the cluster's mean of each listed feature."""
    means = stats.select("cluster_id", "feature", F.col("mean").alias("cluster_mean"))
    return join_on(top, means, ["cluster_id", "feature"], "left")


def member_overlay(scaled: DataFrame, ranking: DataFrame) -> DataFrame:
    """Member rows of a cluster's ranked features with raw and scaled value.

    ``scaled`` is long ``(cluster_id, ids, feature, value, value_norm)``; ``ranking`` is
    ``(cluster_id, feature, order_type, rank)``.
    """
    return join_on(scaled, ranking.select("cluster_id", "feature", "order_type", "rank"), ["cluster_id", "feature"])
