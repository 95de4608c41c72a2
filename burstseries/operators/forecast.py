"""Forecast scoring on the burst sequence and on the expanded timeline, and model hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstseries.functions.arrays import head
from burstseries.functions.ordered import with_row
from burstseries.operators.bursts import bursts_covering, expand_timeline
from burstseries.operators.distances import tail_wasserstein
from burstseries.operators.features import fano
from burstseries.operators.order_stats import column_medians
from burstseries.session import cut_lineage

# ---- metrics on two arrays ----------------------------------------------------------------


def _pairs(pred: Column, truth: Column) -> Column:
    n = F.least(F.size(pred), F.size(truth))
    return F.zip_with(
        head(pred, n), head(truth, n), lambda f, a: F.struct(f.cast("double").alias("f"), a.cast("double").alias("a"))
    )


def _mean(arr: Column, f) -> Column:
    total = F.aggregate(arr, F.lit(0.0), lambda s, p: s + f(p))
    return total / F.nullif(F.size(arr).cast("double"), F.lit(0.0))


def mae(pred: Column, truth: Column) -> Column:
    return _mean(_pairs(pred, truth), lambda p: F.abs(p["f"] - p["a"]))


def nonzero_mae(pred: Column, truth: Column, threshold: float = 0.0) -> Column:
    """Only where the truth is over the threshold; null when it never is."""
    return _mean(F.filter(_pairs(pred, truth), lambda p: p["a"] > threshold), lambda p: F.abs(p["f"] - p["a"]))


def nonzero_mape(pred: Column, truth: Column, threshold: float = 0.0, scale: float = 1.0, eps: float = 1e-12) -> Column:
    """Mean relative error in scaled units where the truth is over the threshold."""
    near = F.filter(_pairs(pred, truth), lambda p: p["a"] > threshold)
    return _mean(near, lambda p: F.abs(p["f"] / scale - p["a"] / scale) / (p["a"] / scale + eps))


def percent_mape(pred: Column, truth: Column, floor: float = 0.5) -> Column:
    """Mean percentage error over steps whose truth is larger than ``floor`` in size."""
    near = F.filter(_pairs(pred, truth), lambda p: F.abs(p["a"]) > floor)
    return _mean(near, lambda p: F.abs((p["a"] - p["f"]) / p["a"])) * 100.0


def zero_below(arr: Column, threshold: float) -> Column:
    if threshold <= 0:
        return arr
    return F.transform(arr, lambda x: F.when(x < threshold, F.lit(0).cast("double")).otherwise(x.cast("double")))


def apply_value_threshold(df: DataFrame, columns: Sequence[str], truth: str, threshold: float) -> DataFrame:
    """Burst values under the threshold become 0; series without a true burst left are dropped."""
    if threshold <= 0:
        return df
    out = df.withColumns({c: zero_below(F.col(c), threshold) for c in columns})
    return out.filter(F.exists(truth, lambda x: x > 0))


def burst_metrics(
    df: DataFrame,
    keys: Sequence[str],
    *,
    threshold: float = 0.0,
    nonzero: float = 0.0,
    scale: float = 1.0,
) -> DataFrame:
    """Per-series errors of both streams.

    Expects ``gt_bi, pred_bi, gt_ibg, pred_ibg`` and ``context_bi``, ``context_ibg``.
    """
    base = apply_value_threshold(df, ["gt_bi", "pred_bi", "context_bi"], "gt_bi", threshold)
    out: dict[str, Column] = {}
    for s in ("bi", "ibg"):
        pred, gt = F.col(f"pred_{s}"), F.col(f"gt_{s}")
        up = s.upper()
        out[f"MAE_{up}"] = mae(pred, gt)
        out[f"NZ_MAE_{up}"] = nonzero_mae(pred, gt, nonzero)
        out[f"NZ_SCALED_{up}"] = nonzero_mape(pred, gt, nonzero, scale)
        out[f"WD_{up}"] = tail_wasserstein(gt, pred, nonzero)
        out[f"fano_input_{s}"] = fano(F.col(f"context_{s}"))
        out[f"fano_gt_{s}"] = fano(gt)
        out[f"fano_forecast_{s}"] = fano(pred)
    return base.select(*keys, *[c.alias(n) for n, c in out.items()])


def merged_metrics(
    df: DataFrame,
    keys: Sequence[str],
    *,
    threshold: float = 0.0,
    nonzero: float = 0.0,
    scale: float = 1.0,
    prefix: int | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Errors on the expanded timeline, also with true gaps (``ORACLE_IBG``) or true values (``ORACLE_BI``).

    The prefix is the truth's whole timeline or its first ``prefix`` slots; the forecast uses as many
    bursts as the truth needs to cover it.
    """
    base = apply_value_threshold(df, ["gt_bi", "pred_bi"], "gt_bi", threshold)
    whole = expand_timeline(F.col("gt_ibg"), F.col("gt_bi"), cap)
    one = base.withColumn("__full", whole)
    n = F.size("__full")
    length = n if prefix is None else F.least(F.lit(max(0, prefix)), n)
    two = one.withColumns({"__len": length, "__k": bursts_covering(F.col("gt_ibg"), length, cap)})
    three = two.withColumns(
        {
            "__gt": head("__full", F.col("__len")),
            "__kf": F.least(F.col("__k"), F.size("pred_bi"), F.size("pred_ibg")),
        }
    )

    def cut(c: str) -> Column:
        return head(c, F.col("__kf"))

    four = three.withColumns(
        {
            "__fc": expand_timeline(cut("pred_ibg"), cut("pred_bi"), cap),
            "__oi": expand_timeline(cut("gt_ibg"), cut("pred_bi"), cap),
            "__ob": expand_timeline(cut("pred_ibg"), cut("gt_bi"), cap),
        }
    )
    five = four.withColumn("__lm", F.least(F.col("__len"), F.size("__fc"), F.size("__gt")))

    def on(c: str) -> tuple[Column, Column, Column]:
        m = F.least(F.col("__lm"), F.size(c))
        return m, head(c, m), head("__gt", m)

    out: dict[str, Column] = {}
    m, fc, gt = on("__fc")
    out["MAE_EXPANDED_MERGED"] = F.when(m > 0, mae(fc, gt))
    out["NZ_SCALED_MERGED"] = F.when(m > 0, nonzero_mape(fc, gt, nonzero, scale))
    out["WD_EXPANDED_MERGED"] = F.when(m > 0, tail_wasserstein(fc, gt, 0.0))
    for c, name in (("__oi", "ORACLE_IBG"), ("__ob", "ORACLE_BI")):
        m, fc, gt = on(c)
        out[f"MAPE_{name}"] = F.when(m > 0, nonzero_mape(fc, gt, nonzero, scale))
        out[f"WD_{name}"] = F.when(m > 0, tail_wasserstein(fc, gt, 0.0))
    return five.select(
        *keys,
        F.col("__len").alias("merged_len"),
        F.col("__kf").alias("bursts_used"),
        *[c.alias(x) for x, c in out.items()],
    )


MEANS = (
    "MAE_BI",
    "NZ_MAE_BI",
    "NZ_SCALED_BI",
    "WD_BI",
    "MAE_IBG",
    "NZ_MAE_IBG",
    "NZ_SCALED_IBG",
    "WD_IBG",
    "MAE_EXPANDED_MERGED",
    "NZ_SCALED_MERGED",
    "WD_EXPANDED_MERGED",
    "MAPE_ORACLE_IBG",
    "WD_ORACLE_IBG",
    "MAPE_ORACLE_BI",
    "WD_ORACLE_BI",
)
# Fixed names: report column -> the per-series column it is the median of.
MEDIANS = {
    "median_NZ_SCALED": "NZ_SCALED_BI",
    "median_MAPE": "NZ_SCALED_BI",
    "median_WD": "WD_BI",
    "median_NZ_SCALED_MERGED": "NZ_SCALED_MERGED",
    "median_WD_merged": "WD_EXPANDED_MERGED",
    "median_WD_oracle_ibg": "WD_ORACLE_IBG",
    "median_WD_oracle_bi": "WD_ORACLE_BI",
}


def metric_report(per_series: DataFrame) -> DataFrame:
    """Means and medians over series, missing values left out; the medians are selected by brackets."""
    per_series = cut_lineage(per_series, "forecast-metrics")

    def present(c: str) -> Column:
        return F.nanvl(F.col(c), F.lit(None).cast("double"))

    means = per_series.agg(
        F.count(F.lit(1)).alias("num_series_test"),
        *[F.avg(present(c)).alias(f"mean_{c}") for c in MEANS],
        F.avg(present("NZ_SCALED_BI")).alias("mean_MAPE"),
    )
    return with_row(means, column_medians(per_series, MEDIANS))


def token_accuracy(df: DataFrame, streams: Sequence[str] = ("bi", "ibg"), pad: int = 0, skip: int = 0) -> DataFrame:
    """Share of predicted tokens that match, per stream and over all valid positions.

    Reads ``pred_tok_<s>`` and ``gt_tok_<s>``; the first ``skip`` positions can be left out.
    """
    aggs, hits_all, total_all = [], F.lit(0), F.lit(0)
    for s in streams:
        z = F.transform(
            F.zip_with(
                F.col(f"pred_tok_{s}"), F.col(f"gt_tok_{s}"), lambda p, g: F.struct(p.alias("p"), g.alias("g"))
            ),
            lambda x, i: F.struct(
                (x["g"].isNotNull() & x["p"].isNotNull() & (x["g"] != pad) & (i >= skip)).alias("ok"),
                F.coalesce(x["p"] == x["g"], F.lit(False)).alias("hit"),
            ),
        )
        hits = F.sum(F.size(F.filter(z, lambda x: x["ok"] & x["hit"])))
        total = F.sum(F.size(F.filter(z, lambda x: x["ok"])))
        aggs += [hits.alias(f"__h_{s}"), total.alias(f"__t_{s}")]
        hits_all, total_all = hits_all + F.col(f"__h_{s}"), total_all + F.col(f"__t_{s}")
    sums = df.agg(*aggs)

    def share(a: Column, b: Column) -> Column:
        return a / F.nullif(b, F.lit(0).cast("long"))

    return sums.select(
        *[share(F.col(f"__h_{s}"), F.col(f"__t_{s}")).alias(f"accuracy_{s}") for s in streams],
        share(hits_all, total_all).alias("accuracy"),
        total_all.alias("n_positions"),
    )


# ---- predictors and hooks -----------------------------------------------------------------


def predict_last(df: DataFrame) -> DataFrame:
    """Repeat the last context value and gap over the horizon."""
    return df.withColumns({f"pred_{s}": _repeat(F.element_at(f"context_{s}", -1), f"gt_{s}") for s in ("bi", "ibg")})


def predict_median(df: DataFrame) -> DataFrame:
    """Repeat the lower middle of the context's sorted values over the horizon."""

    def mid(s: str) -> Column:
        n = F.size(f"context_{s}")
        return F.get(F.array_sort(f"context_{s}"), F.floor((n - 1) / F.lit(2)).cast("int"))

    return df.withColumns({f"pred_{s}": _repeat(mid(s), f"gt_{s}") for s in ("bi", "ibg")})


def _repeat(value: Column, like: str) -> Column:
    return F.transform(like, lambda _: value.cast("double"))


def score_batches(
    df: DataFrame,
    predict: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Run a user's model over Arrow batches; it gets a frame of series and returns rows of ``schema``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield predict(frame)

    return df.mapInPandas(run, schema)


def predict_resampled(df: DataFrame, keys: Sequence[str], draws: int = 32, seed: int = 42) -> DataFrame:
    """Per step draw context items, keep the drawn one nearest to the draws' median.

    The generator is seeded per series, so the result does not depend on partitioning.
    """
    keys = list(keys)
    seeded = df.withColumn("__seed", F.abs(F.xxhash64(F.lit(seed), *keys)) % F.lit(2**31))

    def one(context, horizon: int, rng: np.random.Generator) -> list[float]:
        values = np.asarray(context, dtype=float)
        got = rng.choice(values, size=(horizon, draws))
        mid = np.sort(got, axis=1)[:, (draws - 1) // 2]
        at = np.abs(got - mid[:, None]).argmin(axis=1)
        return got[np.arange(horizon), at].tolist()

    def predict(frame: pd.DataFrame) -> pd.DataFrame:
        out = {"pred_bi": [], "pred_ibg": []}
        for row in frame.itertuples(index=False):
            rng = np.random.default_rng(int(row.seed_))
            for s in ("bi", "ibg"):
                out[f"pred_{s}"].append(one(getattr(row, f"context_{s}"), len(getattr(row, f"gt_{s}")), rng))
        return frame[[*keys, "context_bi", "context_ibg", "gt_bi", "gt_ibg"]].assign(**out)

    base = seeded.select(*keys, "context_bi", "context_ibg", "gt_bi", "gt_ibg", F.col("__seed").alias("seed_"))
    arrays = [T.StructField(f"pred_{s}", T.ArrayType(T.DoubleType())) for s in ("bi", "ibg")]
    schema = T.StructType([f for f in base.schema if f.name != "seed_"] + arrays)
    return score_batches(base, predict, schema)


def embed_batches(
    df: DataFrame, keys: Sequence[str], embed: Callable[[pd.DataFrame], np.ndarray], dims: int, prefix: str = "repr_dim_"
) -> DataFrame:
    """Run a user's embedder over Arrow batches; it returns one row of ``dims`` numbers per series."""
    names = [f"{prefix}{i}" for i in range(dims)]
    schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(np.asarray(embed(frame), dtype=float), columns=names, index=frame.index)
        return pd.concat([frame[list(keys)], got], axis=1)

    return score_batches(df, run, schema)


def step_embeddings(df: DataFrame, keys: Sequence[str], column: str, window: int) -> DataFrame:
    """One row per time step: the last ``window`` items as vector, with the next value as target."""
    n = F.size(column)
    each = df.filter(n > window).select(
        *keys, column, F.explode(F.sequence(F.lit(window), n - 1)).alias("time_step")
    )
    return each.select(
        *keys,
        "time_step",
        F.slice(F.col(column), F.col("time_step") - window + 1, F.lit(window)).alias("vector"),
        F.get(column, F.col("time_step")).cast("double").alias("target"),
    )


def probe_on_vectors(
    df: DataFrame,
    vector: str,
    target: str,
    task: str,
    *,
    keys: Sequence[str],
    train_fraction: float = 0.8,
    seed: int = 42,
    hidden: Sequence[int] = (),
    max_iter: int = 100,
) -> DataFrame:
    """Fit a head on vectors and score it on a held-out part: ``(task, metric, value, n_train, n_val)``.

    ``regression`` reports RMSE, ``binary`` and ``multiclass`` accuracy; hidden layers make the
    classifier a perceptron.
    """
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    from burstseries.functions.hashing import unit_hash
    from burstseries.session import cut_lineage

    data = cut_lineage(
        df.select(
            *keys,
            array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
            F.col(target).cast("double").alias("label"),
            F.size(vector).alias("dims"),
        ).withColumn("train", unit_hash(keys, seed) < train_fraction),
        "probe",
    )
    train, val = data.filter("train"), data.filter("not train")
    if task == "regression":
        model = LinearRegression(maxIter=max_iter, regParam=1e-6).fit(train)
    elif task in ("binary", "multiclass") and hidden:
        facts = data.agg(F.max("label").alias("top"), F.max("dims").alias("d")).first()
        layers = [int(facts["d"]), *hidden, int(facts["top"]) + 1]
        model = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=max_iter).fit(train)
    elif task in ("binary", "multiclass"):
        family = "binomial" if task == "binary" else "multinomial"
        model = LogisticRegression(maxIter=max_iter, family=family, regParam=1e-4).fit(train)
    else:
        raise ValueError("task is 'regression', 'binary' or 'multiclass'")
    scored = model.transform(val)
    error = F.col("prediction") - F.col("label")
    if task == "regression":
        value, name = F.sqrt(F.avg(error * error)), "rmse"
    else:
        value, name = F.avg((error == 0).cast("double")), "accuracy"
    sizes = data.agg(
        F.count(F.when(F.col("train"), True)).alias("n_train"), F.count(F.when(~F.col("train"), True)).alias("n_val")
    )
    from burstseries.functions.ordered import with_row

    out = scored.agg(value.alias("value")).select(F.lit(task).alias("task"), F.lit(name).alias("metric"), "value")
    return with_row(out, sizes)
