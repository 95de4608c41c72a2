"""Comparing clustering runs of a parameter grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstseries.functions.ordered import join_on


def run_means(scores: DataFrame) -> DataFrame:
    """Mean ratio over features per (k, run, seed); text that is no number is left out."""
    ratio = F.col("fisher_ratio").try_cast("double")
    return (
        scores.withColumn("__r", ratio)
        .filter(F.col("__r").isNotNull())
        .groupBy("k", "run", "seed")
        .agg(F.avg("__r").alias("mean_fisher"), F.count(F.lit(1)).alias("n_features"))
    )


def best_runs(means: DataFrame) -> DataFrame:
    """Per k the largest mean and the run(s) that reach it; run and seed are null on a tie."""
    top = means.groupBy("k").agg(
        F.max("mean_fisher").alias("best_mean_fisher"), F.count_distinct("run", "seed").alias("n_configs_with_scores")
    )
    winners = join_on(means, top, ["k"]).filter(F.col("mean_fisher") == F.col("best_mean_fisher"))
    name = F.concat_ws("_", F.concat(F.lit("run"), F.col("run")), F.concat(F.lit("seed"), F.col("seed")))
    one = F.count(F.lit(1)) == 1
    return winners.groupBy("k", "best_mean_fisher", "n_configs_with_scores").agg(
        F.when(one, F.min("run")).alias("best_run"),
        F.when(one, F.min("seed")).alias("best_seed"),
        F.concat_ws(",", F.array_sort(F.collect_set(name))).alias("best_runs_tied"),
    )
