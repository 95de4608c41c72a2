"""The stages chained end to end, each writing its tables below one folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.operators import bursts as B
from burstseries.operators import clusters as C
from burstseries.operators import dense as D
from burstseries.operators import distances as X
from burstseries.operators import explain as E
from burstseries.operators import features as FE
from burstseries.operators import flows as FL
from burstseries.operators import gram as G
from burstseries.operators import keys as K
from burstseries.operators import quantiles as Q
from burstseries.operators import retrieval as R
from burstseries.operators import splits as S
from burstseries.session import cut_lineage
from burstseries.sources.sinks import write_per_cluster, write_products

# Fixed names: entity level -> the columns that identify a series (the source is always added).
LEVEL_KEYS = {
    "ip": ["ip"],
    "ip_service": ["ip", "service_port"],
    "subnet": ["subnet"],
    "ip2ip": ["src_ip", "dst_ip"],
}


def packets_to_series(
    packets: DataFrame,
    out_dir: str,
    *,
    bin_ms: int = 1000,
    threshold: float = 100,
    max_len: int | None = None,
    min_len: int = 3,
    truncate: str = "span",
) -> dict[str, DataFrame]:
    """Packets to dense series at the four entity levels, with their quantile table."""
    spark = packets.sparkSession
    traffic = FL.packet_bytes(packets)
    ticks = FL.entity_ticks(FL.both_ends(traffic))
    bins = cut_lineage(FL.level_bins(ticks, bin_ms), "level-bins")
    tables = {level: bins.filter(F.col("level") == level) for level in ("ip", "ip_service", "subnet")}
    tables["ip2ip"] = FL.pair_bins(FL.pair_ticks(traffic), bin_ms)
    both = {"inbound": "total_inbound_bytes", "outbound": "total_outbound_bytes"}
    series = {
        level: D.dense_series(
            table,
            [*LEVEL_KEYS[level], "source_file"],
            both,
            threshold=threshold,
            max_len=max_len,
            min_len=min_len,
            truncate=truncate,
        )
        for level, table in tables.items()
    }
    write_products({f"series_{k}": v for k, v in series.items()}, out_dir)
    stored = {k: spark.read.parquet(f"{out_dir}/series_{k}") for k in series}
    quantiles = None
    for level, table in stored.items():
        part = Q.item_quantiles(table.withColumn("entity_type", F.lit(level)), "inbound", ["entity_type"])
        quantiles = part if quantiles is None else quantiles.unionByName(part)
    write_products({"quantiles": quantiles}, out_dir)
    return stored


def resolve_threshold(quantiles: DataFrame, entity_type: str, q: float) -> float:
    """The interpolated burst threshold of one entity type (one number reaches the driver)."""
    row = quantiles.filter(F.col("entity_type") == entity_type).select(
        Q.interpolate(F.col("levels").cast("array<double>"), F.col("quantiles").cast("array<double>"), q).alias("t")
    ).first()
    if row is None or row["t"] is None:
        raise ValueError(f"no quantiles for {entity_type}")
    return float(row["t"])


def series_to_splits(
    series: DataFrame,
    keys: Sequence[str],
    out_dir: str,
    *,
    threshold: float,
    min_len: int = 3,
    max_len: int | None = None,
    min_bursts: int = 3,
    train_ratio: float = 0.7,
    context_ratio: float = 0.7,
    seed: int = 42,
    mode: str = "burst_timestamp",
    strict_parity: bool = True,
    existing_bursts: DataFrame | None = None,
    existing_meta: DataFrame | None = None,
) -> None:
    """Dense series to bursts, splits and mirrored series.

    ``existing_bursts`` skips extraction and ``existing_meta`` skips splitting (mirror only).
    """
    spark = series.sparkSession
    meta = existing_meta
    if meta is None:
        bursts = existing_bursts
        if bursts is None:
            write_products(
                {"bursts": B.bursts_from_series(series, keys, threshold=threshold, min_len=min_len, max_len=max_len)},
                out_dir,
            )
            bursts = spark.read.parquet(f"{out_dir}/bursts")
        made = S.make_splits(
            bursts,
            keys,
            train_ratio=train_ratio,
            context_ratio=context_ratio,
            min_bursts=min_bursts,
            min_len=min_len,
            max_len=max_len,
            seed=seed,
        )
        # one write, partitioned by side; both sides and the meta table are read off it
        made.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(f"{out_dir}/splits")
        meta = S.splits_meta(spark.read.parquet(f"{out_dir}/splits"), keys)
        write_products({"splits_meta": meta}, out_dir)
        meta = spark.read.parquet(f"{out_dir}/splits_meta")
    mirrored = S.mirror_series(series, meta, keys, mode=mode, threshold=threshold)
    mirrored.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(f"{out_dir}/mirrored")
    if mode == "burst_timestamp":
        S.burst_parity(spark.read.parquet(f"{out_dir}/mirrored"), strict=strict_parity).collect()


def explain_clusters(
    labels: DataFrame,
    features: DataFrame,
    out_dir: str,
    *,
    keys: Sequence[str] = ("ip", "source_file"),
    label: str = "label",
    min_cluster_size: int = 5,
    at_least: float = 0.1,
    top_k: int = 10,
) -> None:
    """Scores, effects, similarity and importance tables of labelled representations and features."""
    names = FE.feature_columns(features, exclude=keys)
    reps = FE.feature_columns(labels, prefix="repr_dim", exclude=[*keys, label])
    names = FE.present_columns(features, names)
    joined = K.prefixed_join(FE.coerce_numeric(features, names), labels, keys).withColumnRenamed(label, "cluster_id")
    wide = cut_lineage(joined, "labelled")
    long = FE.to_long(wide, ["cluster_id", *keys], names)
    stats = cut_lineage(E.cluster_stats(long), "stats")
    scores = cut_lineage(E.invariance_scores(stats, min_cluster_size), "scores")
    kept = cut_lineage(E.fisher_select(scores, at_least).withColumnRenamed("fisher_rank", "rank"), "kept")
    E.require_rows(kept, f"no feature reaches a variance ratio of {at_least}")
    effects = cut_lineage(E.cohens_d(stats), "effects")
    pop = cut_lineage(E.population_stats(stats), "population")
    chosen = [r["feature"] for r in kept.select("feature").collect()]
    cka = cut_lineage(G.feature_similarity(wide, reps, chosen, ["cluster_id"], min_rows=2), "cka")
    ranked = cut_lineage(E.overlay_importance(cka, effects, kept), "importance")
    top = ranked.filter(F.col("rank") <= top_k)
    write_products(
        {
            "invariance_scores": scores,
            "selected_features": kept,
            "cluster_stats": stats,
            "population_stats": pop,
            "effects": effects,
            "cka_per_cluster": cka,
            "global_metrics": E.fisher_cka_table(
                E.global_fisher(stats), G.feature_similarity(wide, reps, names).drop("n")
            ),
            "extremes": E.cluster_extremes(effects, pop),
            "rankings": E.ranking_rows(cka, effects, kept, top_k),
            "importance": E.with_cluster_mean(ranked, stats),
            "cluster_importance": E.cluster_importance(top),
            "cluster_sizes": C.cluster_sizes(wide, "cluster_id"),
        },
        out_dir,
    )
    write_per_cluster(top, f"{out_dir}/per_cluster", "cluster_id")


def evaluate_retrieval(
    representations: DataFrame,
    series: DataFrame,
    out_dir: str,
    *,
    id_columns: Sequence[str] = ("ip", "source_file"),
    row_id: str = "row_id",
    vector: str = "vector",
    label: str = "label",
    n_eval: int | None = None,
    fraction: float | None = 0.1,
    n_lists: int = 500,
    n_probe: int = 32,
    top_k: int = 1,
    within_cluster: bool = True,
    seed: int = 42,
) -> None:
    """Split, index, search and distance rows. ``series`` is ``(point_id, series)``."""
    spark: SparkSession = representations.sparkSession
    manifest = cut_lineage(
        R.split_manifest(representations, id_columns, row_id, label, n_eval=n_eval, fraction=fraction, seed=seed),
        "manifest",
    )
    unit = R.unit_vectors(representations.select(row_id, F.col(vector).cast("array<double>").alias("vector")), "vector")
    points = cut_lineage(manifest.join(unit, row_id), "points")
    queries = points.filter("split = 'eval'").select(F.col("point_id").alias("query_id"), "cluster_id", "vector")
    base = points.filter("split = 'train'").select(F.col("point_id").alias("base_id"), "cluster_id", "vector")
    lists = cut_lineage(R.train_lists(base, n_lists, seed=seed), "lists")
    R.write_index(R.assign_lists(base, lists), f"{out_dir}/index")
    assigned = spark.read.parquet(f"{out_dir}/index")
    hits = R.search_lists(
        queries, assigned, lists, top_k, n_probe, cluster="cluster_id" if within_cluster else None
    )
    slots = R.padded_neighbors(queries.select("query_id"), cut_lineage(hits, "hits"), top_k, "query_id", "base_id")
    named = slots.join(queries.select("query_id", "cluster_id"), "query_id").select(
        F.col("query_id").alias("test_point_id"),
        F.col("base_id").alias("neighbor_id"),
        "cluster_id",
        "rank",
        "neighbor_count",
    )
    write_products({"manifest": manifest, "distances": X.distance_rows(named, series)}, out_dir)
    stored = spark.read.parquet(f"{out_dir}/distances")
    kinds = ["wasserstein_distance_normalized", "wasserstein_distance_unnormalized", "dtw_distance_normalized"]
    write_products({"sanity": R.sanity_report(stored, kinds)}, out_dir)
