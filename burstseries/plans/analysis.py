"""Queries over features, clusters, explanations, similarity and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstseries.functions.arrays import item_rows
from burstseries.operators import clusters as C
from burstseries.operators import explain as E
from burstseries.operators import features as X
from burstseries.operators import gram as G
from burstseries.operators import keys as K
from burstseries.operators import quantiles as Q
from burstseries.operators import sweep as W
from burstseries.plans import inputs as src
from burstseries.plans.registry import query
from burstseries.session import cut_lineage, fresh_path


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    names = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def r(digits: int, *columns: str) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


# ---- features -----------------------------------------------------------------------------


@query(
    "features_minimal",
    f"""WITH {src.USER_FEATURES}, s AS (SELECT user_id AS vec_id, sum(v) AS value__sum_values, max(abs(v)) AS value__absolute_maximum FROM dollars GROUP BY ALL)
    SELECT vec_id, {r(5, *src.FEATURES, 'value__sum_values', 'value__absolute_maximum')} FROM user_features JOIN s USING (vec_id)""",
)
def features_minimal(spark, sf):
    return rounded(src.user_features(spark, sf), 5)


EXTENDED = src.USER_FEATURES + """,
o AS (
  SELECT user_id, i, v, lag(v) OVER w AS p1, lag(v, 2) OVER w AS p2, lead(v) OVER w AS n1,
         avg(v) OVER u AS m, stddev_pop(v) OVER u AS sd, min(v) OVER u AS lo, max(v) OVER u AS hi, count(*) OVER u AS n
  FROM dollars WINDOW w AS (PARTITION BY user_id ORDER BY i), u AS (PARTITION BY user_id)),
runs AS (
  SELECT user_id, max(c) AS longest FROM (
    SELECT user_id, g, count(*) AS c FROM (
      SELECT user_id, i, v > m AS up, i - row_number() OVER (PARTITION BY user_id, v > m ORDER BY i) AS g FROM o)
    WHERE up GROUP BY ALL) GROUP BY ALL),
bins AS (
  SELECT user_id, sum(-p * ln(p)) AS e FROM (
    SELECT user_id, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS b, count(*)::DOUBLE / any_value(n) AS p FROM o GROUP BY ALL)
  GROUP BY ALL),
wide AS (
  SELECT o.user_id AS vec_id, sum(v * v) AS abs_energy, sum(abs(v - p1)) AS absolute_sum_of_changes,
         avg(abs(v - p1)) AS mean_abs_change, sqrt(sum((v - p1) * (v - p1))) AS cid_ce__normalize_False,
         count(*) FILTER (WHERE v > m)::DOUBLE AS count_above_mean, count(*) FILTER (WHERE v < m)::DOUBLE AS count_below_mean,
         min(i) FILTER (WHERE v = hi) / any_value(n)::DOUBLE AS first_location_of_maximum,
         (max(i) FILTER (WHERE v = hi) + 1) / any_value(n)::DOUBLE AS last_location_of_maximum,
         count(*) FILTER (WHERE v = 0) / any_value(n)::DOUBLE AS share_of_zeros,
         count(DISTINCT v) / any_value(n)::DOUBLE AS ratio_value_number_to_time_series_length,
         count(*) FILTER (WHERE (v > 0) <> (p1 > 0))::DOUBLE AS number_crossing_m__m_0,
         sum((v - m) * (p1 - m)) / (any_value(n) - 1) / any_value(sd * sd) AS autocorrelation__lag_1,
         sum(v * p1 * p2) / (any_value(n) - 2) AS c3__lag_1,
         sum(v * v * p1 - p1 * p2 * p2) / (any_value(n) - 2) AS time_reversal_asymmetry_statistic__lag_1,
         count(*) FILTER (WHERE abs(v - m) > 2 * sd) / any_value(n)::DOUBLE AS ratio_beyond_r_sigma__r_2,
         quantile_cont(v, 0.9) AS quantile__q_0_9, skewness(v) AS skewness, kurtosis(v) AS kurtosis,
         regr_slope(v, i) AS linear_trend__attr_slope, regr_intercept(v, i) AS linear_trend__attr_intercept,
         corr(v, i) AS linear_trend__attr_rvalue,
         count(*) FILTER (WHERE v > p1 AND v > n1)::DOUBLE AS number_peaks__n_1
  FROM o GROUP BY o.user_id)"""

EXTENDED_COLS = [
    "abs_energy", "absolute_sum_of_changes", "mean_abs_change", "cid_ce__normalize_False", "count_above_mean",
    "count_below_mean", "first_location_of_maximum", "last_location_of_maximum", "share_of_zeros",
    "ratio_value_number_to_time_series_length", "number_crossing_m__m_0", "autocorrelation__lag_1",
    "ratio_beyond_r_sigma__r_2", "quantile__q_0_9", "skewness", "kurtosis", "linear_trend__attr_slope",
    "linear_trend__attr_intercept", "linear_trend__attr_rvalue", "number_peaks__n_1",
]
CUBIC = ["c3__lag_1", "time_reversal_asymmetry_statistic__lag_1"]


@query(
    "features_extended",
    f"""WITH {EXTENDED} SELECT w.vec_id, {', '.join(f'round({c}, 5) + 0.0 AS value__{c}' for c in EXTENDED_COLS)},
    {', '.join(f'round({c}, 2) + 0.0 AS value__{c}' for c in CUBIC)},
    r.longest::DOUBLE AS value__longest_strike_above_mean, round(b.e, 5) AS value__binned_entropy__max_bins_10
    FROM wide w JOIN runs r ON r.user_id = w.vec_id JOIN bins b ON b.user_id = w.vec_id""",
)
def features_extended(spark, sf):
    whole = src.series(spark, sf).select(
        F.col("user_id").alias("vec_id"), F.transform("inbound", lambda x: x / 100.0).alias("s")
    )
    got = X.extended_features(whole, ["vec_id"], "s")
    plain = [*EXTENDED_COLS, "longest_strike_above_mean", "binned_entropy__max_bins_10"]
    out = got.select("vec_id", *[F.col(f"value__{c}") for c in [*plain, *CUBIC]])
    out = rounded(out, 2, *[f"value__{c}" for c in CUBIC])
    return rounded(out, 5, *[f"value__{c}" for c in plain])


@query("features_spectral")
def features_spectral(spark, sf):
    s = src.series(spark, sf).select("user_id", X.fixed_length(F.col("inbound"), 600).alias("s"))
    return rounded(X.spectral_features(s, ["user_id"], "s"), 4)


@query(
    "fixed_length",
    f"""WITH {src.SERIES}, n AS (SELECT user_id, sum(vin) FILTER (WHERE i < 400)::DOUBLE AS s400, count(*) AS n FROM series GROUP BY ALL)
    SELECT user_id, CAST(400 AS INTEGER) AS cut_n, s400 AS cut_sum, CAST(900 AS INTEGER) AS padded_n, t.s AS padded_sum
    FROM n JOIN (SELECT user_id, sum(vin)::DOUBLE AS s FROM series GROUP BY ALL) t USING (user_id)""",
)
def fixed_length(spark, sf):
    s = src.series(spark, sf)
    cut, pad = X.fixed_length(F.col("inbound"), 400), X.fixed_length(F.col("inbound"), 900)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return s.select(
        "user_id", F.size(cut).alias("cut_n"), total(cut).alias("cut_sum"), F.size(pad).alias("padded_n"),
        total(pad).alias("padded_sum"),
    )


def _stat_sql(c, v):
    return f"""count(*)::DOUBLE AS feat_{c}_len, sum({v})::DOUBLE AS feat_{c}_sum, round(avg({v}), 5) AS feat_{c}_mean,
    round(stddev_pop({v}), 4) AS feat_{c}_std, max({v})::DOUBLE AS feat_{c}_max, count(*) FILTER (WHERE {v} <> 0)::DOUBLE AS feat_{c}_nonzero,
    max_by({v}, -i)::DOUBLE AS feat_{c}_first, max_by({v}, i)::DOUBLE AS feat_{c}_last"""


@query("simple_stats", f"WITH {src.SERIES} SELECT user_id, {_stat_sql('inbound', 'vin')}, {_stat_sql('outbound', 'vout')} FROM series GROUP BY user_id")
def simple_stats(spark, sf):
    out = X.simple_stats(src.series(spark, sf), ["user_id"])
    out = rounded(out, 5, "feat_inbound_mean", "feat_outbound_mean")
    return rounded(out, 4, "feat_inbound_std", "feat_outbound_std")


@query(
    "fano_by_series",
    f"""WITH {src.BURSTS} SELECT user_id, round(CASE WHEN count(*) >= 2 THEN var_pop(bi) / avg(bi) END, 4) AS fano_bi,
    round(CASE WHEN count(*) >= 2 THEN var_samp(ibg) / avg(ibg) END, 6) AS fano_ibg_sample FROM bursts GROUP BY ALL""",
)
def fano_by_series(spark, sf):
    b = src.bursts(spark, sf)
    return b.select(
        "user_id",
        F.round(X.fano(F.col("bi")), 4).alias("fano_bi"),
        F.round(X.fano(F.col("ibg"), sample=True), 6).alias("fano_ibg_sample"),
    )


# ---- wide tables --------------------------------------------------------------------------

DIRTY = """
dirty AS (
  SELECT c_custkey, c_nationkey::DOUBLE AS a, CASE WHEN c_acctbal < 1500 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS b,
         CASE WHEN c_nationkey = 3 THEN 'Infinity' WHEN c_nationkey = 5 THEN 'NaN' ELSE CAST(c_nationkey * 2 AS VARCHAR) END AS c,
         7.0::DOUBLE AS d, CASE WHEN c_acctbal > 2000 THEN c_acctbal END AS e, 'word' AS f,
         CASE WHEN c_nationkey = 0 THEN 0.0 ELSE c_acctbal END AS g
  FROM customer),
num AS (
  SELECT c_custkey, a, try_cast(b AS DOUBLE) AS b, try_cast(c AS DOUBLE) AS c, d, e, try_cast(f AS DOUBLE) AS f, g FROM dirty)"""


def _dirty(spark, sf):
    c = src.table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    nation, bal = F.col("c_nationkey"), F.col("c_acctbal")
    return c.select(
        "c_custkey",
        nation.cast("double").alias("a"),
        F.when(bal < 1500, "n/a").otherwise(bal.cast("string")).alias("b"),
        F.when(nation == 3, "Infinity").when(nation == 5, "NaN").otherwise((nation * 2).cast("string")).alias("c"),
        F.lit(7.0).alias("d"),
        F.when(bal > 2000, bal).alias("e"),
        F.lit("word").alias("f"),
        F.when(nation == 0, 0.0).otherwise(bal).alias("g"),
    )


DIRTY_COLS = ["a", "b", "c", "d", "e", "f", "g"]


@query(
    "numeric_coerce",
    f"""WITH {DIRTY}, l AS (SELECT feature, value FROM num UNPIVOT INCLUDE NULLS (value FOR feature IN (a, b, c, d, e, f, g))),
    n AS (SELECT feature, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM l WHERE value IS NULL OR NOT isinf(value))
    SELECT feature, count(*) AS n_rows, count(value) AS n, round(var_pop(value), 3) AS var, round(avg((value = 0)::INT), 6) AS frac_zero,
           coalesce(var_pop(value) <= 1e-12, true) AS is_constant FROM n GROUP BY feature""",
)
def numeric_coerce(spark, sf):
    nums = X.coerce_numeric(_dirty(spark, sf), DIRTY_COLS)
    long = X.to_long(nums, ["c_custkey"], DIRTY_COLS)
    finite = long.filter(F.col("value").isNull() | (F.abs("value") != float("inf")))
    out = X.column_stats(finite)
    return rounded(rounded(out, 3, "var"), 6, "frac_zero")


@query(
    "matrix_clean_strict",
    f"""WITH {DIRTY} SELECT c_custkey, a, CASE WHEN isinf(c) OR isnan(c) THEN 0.0 ELSE coalesce(c, 0) END AS c, g FROM num
    WHERE a <> 0 OR (c <> 0 AND NOT isinf(c) AND NOT isnan(c)) OR g <> 0""",
)
def matrix_clean_strict(spark, sf):
    return X.clean_strict(_dirty(spark, sf), ["c_custkey"], DIRTY_COLS)


@query(
    "matrix_clean_minimal",
    f"""WITH {DIRTY} SELECT c_custkey, {', '.join(f'CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END AS {c}' for c in DIRTY_COLS)} FROM num""",
)
def matrix_clean_minimal(spark, sf):
    return X.clean_minimal(_dirty(spark, sf), DIRTY_COLS)


@query(
    "features_impute",
    f"""WITH {DIRTY}, l AS (SELECT c_custkey, feature, value FROM (SELECT c_custkey, a, b, c, e FROM num) UNPIVOT INCLUDE NULLS (value FOR feature IN (a, b, c, e))),
    k AS (SELECT feature, max(value) AS hi, min(value) AS lo, median(value) AS mid FROM l WHERE NOT isnan(value) AND NOT isinf(value) GROUP BY ALL)
    SELECT l.c_custkey, l.feature, CASE WHEN value IS NULL OR isnan(value) THEN mid WHEN value = 'Infinity'::DOUBLE THEN hi
           WHEN value = '-Infinity'::DOUBLE THEN lo ELSE value END AS value FROM l JOIN k USING (feature)""",
)
def features_impute(spark, sf):
    cols = ["a", "b", "c", "e"]
    nums = X.coerce_numeric(_dirty(spark, sf).select("c_custkey", *cols), cols)
    return X.impute_long(X.to_long(nums, ["c_custkey"], cols))


@query(
    "min_max_norm",
    f"""WITH {src.FEATURE_LONG}, k AS (SELECT feature, min(value) AS lo, CASE WHEN max(value) <= min(value) THEN min(value) + 1 ELSE max(value) END AS hi FROM long GROUP BY ALL)
    SELECT cluster_id, vec_id, feature, round(value, 5) AS value, round(least(greatest((value - lo) / (hi - lo + 1e-12), 0), 1), 6) AS value_norm
    FROM long JOIN k USING (feature)""",
)
def min_max_norm(spark, sf):
    out = X.min_max_long(src.feature_long(spark, sf)).drop("lo", "hi")
    return rounded(rounded(out, 5, "value"), 6, "value_norm")


# ---- clusters -----------------------------------------------------------------------------


@query("cluster_sizes", "SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY ALL")
def cluster_sizes(spark, sf):
    return C.cluster_sizes(src.vectors(spark, sf), "cluster_id")


@query("distinct_vectors", "SELECT count(*) AS n_rows, count(DISTINCT list_transform(embedding, lambda x: round(x::DOUBLE, 1) + 0.0)) AS n_distinct FROM embeddings")
def distinct_vectors(spark, sf):
    return C.distinct_vectors(src.vectors(spark, sf), "vector", 1)


@query(
    "member_sample",
    """WITH s AS (SELECT user_id, event_id, ('0x' || substr(md5('42_' || user_id || '_' || event_id), 1, 8))::BIGINT AS h FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) AS sample_rank FROM s)
    SELECT user_id, event_id, CAST(sample_rank AS INTEGER) AS sample_rank FROM k WHERE sample_rank <= 5""",
)
def member_sample(spark, sf):
    ev = src.table(spark, sf, "events", "user_id", "event_id")
    return K.member_sample(ev, "user_id", ["event_id"], 5)


def vector_long(spark, sf) -> DataFrame:
    rows = item_rows(src.vectors(spark, sf), ["cluster_id", "vec_id"], "vector", "feature", "value")
    return rows.withColumn("feature", F.concat(F.lit("repr_dim_"), F.col("feature").cast("string")))


VECTOR_LONG = """
vlong AS (
  SELECT label AS cluster_id, vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS value FROM embeddings)"""


@query(
    "ch_db_scores",
    f"""WITH {VECTOR_LONG},
    s AS (SELECT cluster_id, d, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM vlong GROUP BY ALL),
    g AS (SELECT d, avg(value) AS gm FROM vlong GROUP BY ALL),
    p AS (SELECT sum(n * (m - gm) * (m - gm)) AS ssb, sum(n * v) AS ssw FROM s JOIN g USING (d)),
    dist AS (SELECT cluster_id, vec_id, sqrt(sum((value - m) * (value - m))) AS q FROM vlong JOIN s USING (cluster_id, d) GROUP BY ALL),
    sp AS (SELECT cluster_id, avg(q) AS q FROM dist GROUP BY ALL),
    cd AS (SELECT a.cluster_id AS x, b.cluster_id AS y, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS z FROM s a JOIN s b USING (d) WHERE a.cluster_id <> b.cluster_id GROUP BY ALL),
    w AS (SELECT x, max((sx.q + sy.q) / z) AS r FROM cd JOIN sp sx ON sx.cluster_id = x JOIN sp sy ON sy.cluster_id = y GROUP BY ALL),
    k AS (SELECT count(DISTINCT cluster_id) AS k, count(DISTINCT vec_id) AS n FROM vlong)
    SELECT round(ssb * (n - k) / (ssw * (k - 1)), 6) AS calinski_harabasz, (SELECT round(avg(r), 6) FROM w) AS davies_bouldin,
           'ok' AS status, k AS n_clusters, n AS n_samples FROM p, k""",
)
def ch_db_scores(spark, sf):
    return rounded(C.quality_scores(vector_long(spark, sf), ["vec_id"]), 6)


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    got = C.kmeans_labels(src.vectors(spark, sf), ["vec_id"], "vector", 8, n_init=2, max_iter=20)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("cosine_kmeans_labels")
def cosine_kmeans_labels(spark, sf):
    got = C.cosine_kmeans_labels(src.vectors(spark, sf), ["vec_id"], "vector", 8, n_init=2, max_iter=20)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("norm_kmeans_labels")
def norm_kmeans_labels(spark, sf):
    v = src.user_features(spark, sf).select("vec_id", F.array("value__mean", "value__maximum").alias("vector"))
    got = C.norm_kmeans_labels(v, ["vec_id"], "vector", 4, n_init=2, max_iter=20)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


DENSITY = f"""WITH {src.USER_FEATURES},
    p AS (SELECT vec_id, value__mean AS x, value__standard_deviation / 4 AS y FROM user_features),
    near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4)
    SELECT count(*) AS n_rows, (SELECT count(*) FROM core) AS n_core,
           count(*) FILTER (WHERE vec_id NOT IN (SELECT a FROM near WHERE b IN (SELECT id FROM core))) AS n_noise FROM p"""


def _density(spark, sf):
    pts = src.user_features(spark, sf).select(
        "vec_id", F.array(F.col("value__mean"), F.col("value__standard_deviation") / 4).alias("vector")
    )
    return C.density_labels(pts, ["vec_id"], "vector", eps=0.5, min_samples=4)


@query("density_labels")
def density_labels(spark, sf):
    return _density(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "density_noise",
    DENSITY.replace("(SELECT count(*) FROM core) AS n_core,", ""),
)
def density_noise(spark, sf):
    one = F.lit(1)
    return _density(spark, sf).agg(
        F.count(one).alias("n_rows"), F.count(F.when(F.col("label") == C.NOISE, one)).alias("n_noise")
    )


@query("sweep_best_run")
def sweep_best_run(spark, sf):
    v = src.vectors(spark, sf)
    labels = C.sweep_labels(
        v, ["vec_id"], "vector", ks=[4, 6], seeds=[1, 2], path=fresh_path(spark, "sweep"), max_iter=10
    )
    feats = item_rows(v, ["vec_id"], "vector", "feature", "value")
    grid = ["k", "run", "seed"]
    stats = labels.join(feats, "vec_id").groupBy(*grid, "label", "feature").agg(
        F.count(F.lit(1)).alias("n_members"), F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.var_pop("value").alias("var_all"),
    )
    tagged = stats.withColumn("feature", F.concat_ws("/", *grid, "feature")).withColumnRenamed("label", "cluster_id")
    scores = E.global_fisher(tagged).withColumn("__p", F.split("feature", "/"))
    named = scores.select(
        *[F.get("__p", F.lit(i)).cast("int").alias(g) for i, g in enumerate(grid)], "feature", "fisher_ratio"
    )
    return rounded(W.best_runs(W.run_means(named)), 8, "best_mean_fisher")


@query(
    "best_run_per_k",
    """WITH s AS (SELECT l_linenumber AS k, l_returnflag AS run, l_linestatus AS seed, round(l_quantity, 0) AS fisher_ratio FROM lineitem),
    m AS (SELECT k, run, seed, round(avg(fisher_ratio), 1) AS mean_fisher FROM s GROUP BY ALL),
    t AS (SELECT k, max(mean_fisher) AS best_mean_fisher, count(*) AS n_configs_with_scores FROM m GROUP BY ALL),
    w AS (SELECT m.*, t.best_mean_fisher, t.n_configs_with_scores FROM m JOIN t ON t.k = m.k AND m.mean_fisher = t.best_mean_fisher)
    SELECT k, best_mean_fisher, n_configs_with_scores, CASE WHEN count(*) = 1 THEN min(run) END AS best_run,
           CASE WHEN count(*) = 1 THEN min(seed) END AS best_seed,
           string_agg('run' || run || '_seed' || seed, ',' ORDER BY 'run' || run || '_seed' || seed) AS best_runs_tied
    FROM w GROUP BY ALL""",
)
def best_run_per_k(spark, sf):
    li = src.table(spark, sf, "lineitem", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    scores = li.select(
        F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("seed"),
        F.col("l_quantity").cast("string").alias("fisher_ratio"),
    )
    return W.best_runs(rounded(W.run_means(scores), 1, "mean_fisher"))


# ---- explanation --------------------------------------------------------------------------


def _stats(spark, sf, table=None):
    return E.cluster_stats(src.feature_long(spark, sf, table))


def _stored_stats(spark, sf):
    """The small (cluster, feature) table, stored where a query needs it more than once."""
    return cut_lineage(_stats(spark, sf), "cluster-stats")


@query("cluster_stats", f"WITH {src.FEATURE_LONG} SELECT cluster_id, feature, n_members, n, {r(9, 'mean')}, {r(4, 'var')} FROM stats")
def cluster_stats(spark, sf):
    return rounded(rounded(_stats(spark, sf).drop("var_all"), 9, "mean"), 4, "var")


@query(
    "cluster_value_summary",
    f"""WITH {src.FEATURE_LONG} SELECT cluster_id, feature, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 6) AS std,
    round(min(value), 9) AS min, round(max(value), 9) AS max FROM long GROUP BY ALL""",
)
def cluster_value_summary(spark, sf):
    return rounded(rounded(E.value_summary(src.feature_long(spark, sf)), 6, "std"), 9, "mean", "min", "max")


INVARIANCE = src.FEATURE_LONG + """,
ok AS (SELECT * FROM stats WHERE n_members >= 12),
vl AS (SELECT l.* FROM long l JOIN ok USING (cluster_id, feature)),
tot AS (SELECT feature, avg(value) AS total_mean, var_pop(value) AS total_var FROM vl GROUP BY ALL),
rows AS (SELECT sum(n_members) AS r, count(*) AS c FROM (SELECT DISTINCT cluster_id, n_members FROM ok)),
inv AS (
  SELECT o.feature, avg(var_all) AS within_var_mean, avg(sqrt(var_all) / (abs(mean) + 1e-12)) AS within_cv_mean,
         sum(n_members / r * var_all) AS within_var_weighted, var_pop(mean) AS between_var, any_value(c) AS clusters_used
  FROM ok o, rows WHERE n >= 2 GROUP BY o.feature),
scores AS (
  SELECT feature, total_mean, total_var, within_var_mean, within_cv_mean, within_var_weighted, between_var,
         within_var_weighted / (total_var + 1e-12) AS w_over_t, between_var / (total_var + 1e-12) AS eta2,
         between_var / (within_var_mean + 1e-12) AS fisher_ratio, clusters_used FROM inv JOIN tot USING (feature))"""
BIG = ["total_mean", "total_var", "within_var_mean", "within_var_weighted", "between_var"]
SMALL = ["within_cv_mean", "w_over_t", "eta2", "fisher_ratio"]


@query("invariance_scores", f"WITH {INVARIANCE} SELECT feature, {r(3, *BIG)}, {r(6, *SMALL)}, clusters_used FROM scores")
def invariance_scores(spark, sf):
    out = E.invariance_scores(_stats(spark, sf), min_cluster_size=12)
    return rounded(rounded(out, 3, *BIG), 6, *SMALL)


@query(
    "fisher_select",
    f"""WITH {INVARIANCE}, k AS (SELECT feature, fisher_ratio FROM scores WHERE fisher_ratio >= 0.02)
    SELECT feature, round(fisher_ratio, 6) AS fisher_ratio, CAST(row_number() OVER (ORDER BY fisher_ratio DESC, feature) AS INTEGER) AS fisher_rank FROM k""",
)
def fisher_select(spark, sf):
    scores = E.invariance_scores(_stats(spark, sf), min_cluster_size=12).select("feature", "fisher_ratio")
    return rounded(E.fisher_select(scores, 0.02), 6, "fisher_ratio")


FISHER = src.FEATURE_LONG + """,
fisher AS (
  SELECT feature, var_pop(mean) AS between_var, avg(var_all) AS within_var_mean, count(*) AS n_groups,
         count(var_all) AS n_groups_with_var, var_pop(mean) / (avg(var_all) + 1e-12) AS fisher_ratio FROM stats GROUP BY ALL)"""


@query(
    "global_fisher",
    f"""WITH {FISHER} SELECT feature, {r(3, 'between_var', 'within_var_mean')}, n_groups, n_groups_with_var, {r(6, 'fisher_ratio')} FROM fisher""",
)
def global_fisher(spark, sf):
    return rounded(rounded(E.global_fisher(_stats(spark, sf)), 3, "between_var", "within_var_mean"), 6, "fisher_ratio")


POP = src.FEATURE_LONG + """,
w AS (SELECT *, sum(n_members * mean) OVER (PARTITION BY feature) / sum(n_members) OVER (PARTITION BY feature) AS mp FROM stats),
pop0 AS (
  SELECT feature, any_value(mp) AS mean_pop, sum(n_members * (var + (mean - mp) * (mean - mp))) / sum(n_members) AS var_pop,
         var_pop(mean) / (avg(var) + 1e-12) AS fisher_ratio FROM w GROUP BY ALL),
pop AS (SELECT *, sqrt(var_pop) AS std_pop, CAST(row_number() OVER (ORDER BY fisher_ratio DESC, feature) AS INTEGER) AS fisher_rank FROM pop0)"""


@query(
    "population_stats",
    f"WITH {POP} SELECT feature, {r(3, 'mean_pop', 'var_pop', 'std_pop')}, {r(6, 'fisher_ratio')}, fisher_rank FROM pop",
)
def population_stats(spark, sf):
    out = E.population_stats(_stats(spark, sf))
    return rounded(rounded(out, 3, "mean_pop", "var_pop", "std_pop"), 6, "fisher_ratio")


@query(
    "top_variance_features",
    f"""WITH {POP}, k AS (SELECT CAST(row_number() OVER (ORDER BY var_pop DESC, fisher_rank) AS INTEGER) AS rank, * FROM pop)
    SELECT rank, feature, {r(3, 'var_pop', 'std_pop')}, {r(6, 'fisher_ratio')} FROM k WHERE rank <= 5""",
)
def top_variance_features(spark, sf):
    out = E.top_variance(E.population_stats(_stats(spark, sf)), 5)
    return rounded(rounded(out, 3, "var_pop", "std_pop"), 6, "fisher_ratio")


EFFECTS = POP + """,
rest AS (
  SELECT *, (sum(n_members * mean) OVER f - n_members * mean) / (sum(n_members) OVER f - n_members) AS mean_rest
  FROM stats WINDOW f AS (PARTITION BY feature)),
effects AS (
  SELECT cluster_id, feature, n_members, mean, var,
         CASE WHEN var IS NULL THEN 0.0 ELSE (mean - mean_rest) / greatest(sqrt(var), 1e-3 * (1 + abs(mean_rest))) END AS cohens_d
  FROM rest)"""


def _effects(spark, sf):
    return E.cohens_d(_stats(spark, sf))


@query(
    "cohens_d_rest",
    f"""WITH {EFFECTS} SELECT cluster_id, feature, n_members, {r(4, 'var')}, {r(9, 'mean')}, {r(6, 'cohens_d')}, round(abs(cohens_d), 6) AS abs_cohens_d FROM effects""",
)
def cohens_d_rest(spark, sf):
    return rounded(rounded(rounded(_effects(spark, sf), 4, "var"), 9, "mean"), 6, "cohens_d", "abs_cohens_d")


@query(
    "effects_wide_long",
    f"WITH {EFFECTS} SELECT feature, CAST(cluster_id AS VARCHAR) AS cluster_id, {r(6, 'cohens_d')}, round(abs(cohens_d), 6) AS abs_cohens_d FROM effects",
)
def effects_wide_long(spark, sf):
    wide = E.long_to_wide(_effects(spark, sf).withColumn("cluster_id", F.col("cluster_id").cast("string")), "cohens_d")
    return rounded(E.wide_to_long(wide), 6)


@query(
    "variance_rank",
    f"""WITH {src.FEATURE_LONG}
    SELECT cluster_id, feature, rank() OVER (PARTITION BY cluster_id ORDER BY var NULLS LAST) + (count(*) OVER (PARTITION BY cluster_id, var) - 1) / 2.0::DOUBLE AS variance_rank FROM stats""",
)
def variance_rank(spark, sf):
    return E.variance_rank(_stats(spark, sf)).select("cluster_id", "feature", "variance_rank")


@query("rank_export")
def rank_export(spark, sf):
    return E.rank_export(_stats(spark, sf))


@query(
    "feature_by_cluster_matrix",
    f"""WITH {src.FEATURE_LONG} SELECT feature, {', '.join(f"round(max(var) FILTER (WHERE cluster_id = {k}), 4) AS c{k}" for k in range(10))} FROM stats GROUP BY ALL""",
)
def feature_by_cluster_matrix(spark, sf):
    s = _stats(spark, sf).withColumn("cluster_id", F.concat(F.lit("c"), F.col("cluster_id").cast("string")))
    return rounded(E.long_to_wide(s, "var", [f"c{k}" for k in range(10)]), 4)


@query(
    "lowest_norm_variance",
    f"""WITH {POP}, v AS (SELECT s.cluster_id, s.feature, s.var, p.var_pop, p.fisher_rank, s.var / nullif(p.var_pop, 0) AS norm_var FROM stats s JOIN pop p USING (feature)),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY norm_var, fisher_rank) AS INTEGER) AS rank FROM v WHERE norm_var IS NOT NULL)
    SELECT cluster_id, rank, feature, {r(4, 'var', 'var_pop')}, {r(6, 'norm_var')} FROM k WHERE rank <= 3""",
)
def lowest_norm_variance(spark, sf):
    s = _stored_stats(spark, sf)
    out = E.lowest_norm_variance(s, E.population_stats(s), 3)
    return rounded(rounded(out, 4, "var", "var_pop"), 6, "norm_var")


def _extreme_sql():
    parts = []
    for end, order in (
        ("dmin", "cohens_d, fisher_rank"), ("dmax", "-cohens_d, fisher_rank"),
        ("vmin", "var NULLS LAST, fisher_rank"), ("vmax", "-var NULLS LAST, fisher_rank"),
    ):
        for c in ("feature", "cohens_d", "var", "var_pop"):
            first = f"first({c} ORDER BY {order})"
            if end[0] == "v":
                first = f"CASE WHEN count(var) > 0 THEN {first} END"
            digits = {"cohens_d": 6, "var": 4, "var_pop": 4}.get(c)
            parts.append(f"{first} AS {end}_{c}" if digits is None else f"round({first}, {digits}) + 0.0 AS {end}_{c}")
    return f"""WITH {EFFECTS}, x AS (SELECT e.*, p.var_pop, p.fisher_rank FROM effects e JOIN pop p USING (feature))
    SELECT cluster_id, any_value(n_members) AS n_members, {', '.join(parts)} FROM x GROUP BY cluster_id"""


@query("cluster_extremes", _extreme_sql())
def cluster_extremes(spark, sf):
    s = _stored_stats(spark, sf)
    out = E.cluster_extremes(E.cohens_d(s), E.population_stats(s))
    six = [c for c in out.columns if c.endswith("cohens_d")]
    four = [c for c in out.columns if c.endswith("var") or c.endswith("var_pop")]
    return rounded(rounded(out, 6, *six), 4, *four)


# ---- similarity ---------------------------------------------------------------------------


def _wide(spark, sf):
    """Vectors as columns beside the features of the same id: a stored table, read several times."""
    v = src.vectors(spark, sf)
    reps = v.select("vec_id", *[F.get("vector", F.lit(i)).alias(c) for i, c in enumerate(src.REPR)])
    return cut_lineage(reps.join(src.labelled_features(spark, sf), "vec_id"), "wide")


XY = src.FEATURE_LONG + """,
xs AS (
  SELECT l.vec_id, l.cluster_id, unnest(range(64)) AS i, unnest(e.embedding)::DOUBLE AS x
  FROM labelled l JOIN embeddings e ON e.vec_id = l.vec_id)"""


def _feature_cka_sql(group: str, least: int) -> str:
    """CTEs ``cka`` (one row per group and feature)."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {g}"
    join_xx = f"JOIN xx USING ({group})" if group else ", xx"
    xkey = f"a.{group}, " if group else ""
    return f"""{XY},
    xc AS (SELECT vec_id, {g}i, x - avg(x) OVER ({part}i) AS x FROM xs),
    yc AS (SELECT vec_id, {g}feature, value, value - avg(value) OVER ({part}feature) AS y FROM long),
    num AS (SELECT {g}feature, sum(s * s) AS num FROM (
      SELECT {'yc.' + group + ', ' if group else ''}feature, i, sum(x * y) AS s FROM yc JOIN xc USING (vec_id) GROUP BY ALL) GROUP BY ALL),
    xx AS (SELECT {g}sqrt(sum(s * s)) AS xx FROM (
      SELECT {xkey}a.i AS i, b.i AS j, sum(a.x * b.x) AS s FROM xc a JOIN xc b USING (vec_id) GROUP BY ALL) GROUP BY ALL),
    yy AS (SELECT {g}feature, sum(y * y) AS yy, var_pop(value) AS var, avg((value = 0)::INT) AS frac_zero, count(*) AS n FROM yc GROUP BY ALL),
    cka AS (SELECT {g}feature, CASE WHEN var <= 1e-12 THEN 0.0 ELSE coalesce(num / nullif(xx * yy, 0), 0) END AS cka_to_embedding,
                   var, frac_zero, var <= 1e-12 AS is_constant, n
            FROM yy JOIN num USING ({g}feature) {join_xx} WHERE n >= {least})"""


CKA = _feature_cka_sql("", 1)
CKA_CLUSTER = _feature_cka_sql("cluster_id", 2)


def _cka(spark, sf):
    return G.feature_similarity(_wide(spark, sf), src.REPR, src.FEATURES)


def _cka_cluster(wide):
    return G.feature_similarity(wide, src.REPR, src.FEATURES, ["cluster_id"], min_rows=2)


def _cka_and_stats(spark, sf):
    """Similarity per cluster and cluster statistics from one stored table."""
    wide = _wide(spark, sf)
    return _cka_cluster(wide), cut_lineage(_stats(spark, sf, wide), "cluster-stats")


@query("cka_per_feature", f"WITH {CKA} SELECT feature, {r(6, 'cka_to_embedding')}, {r(3, 'var')}, {r(6, 'frac_zero')}, is_constant, n FROM cka")
def cka_per_feature(spark, sf):
    return rounded(rounded(_cka(spark, sf), 3, "var"), 6, "cka_to_embedding", "frac_zero")


@query("cka_per_cluster", f"WITH {CKA_CLUSTER} SELECT cluster_id, feature, {r(6, 'cka_to_embedding')}, n FROM cka")
def cka_per_cluster(spark, sf):
    return rounded(_cka_cluster(_wide(spark, sf)).select("cluster_id", "feature", "cka_to_embedding", "n"), 6)


GAP_FEATURES = ["f0", "f1", "f2", "f3", "f4"]


def _gaps(spark, sf):
    """Vectors of 6 dimensions and 5 figures of them: one whole, three with gaps of their own, one empty."""
    v = src.table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    x = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(src.REPR[:6])]
    y = [F.get("embedding", F.lit(10 + i)).cast("double") for i in range(5)]
    figures = [
        y[0], F.when(F.col("vec_id") % 2 == 0, y[1]), F.when(F.col("vec_id") % 3 != 0, y[2]),
        F.when(F.col("vec_id") % 5 != 0, y[3]).otherwise(F.lit(float("nan"))), F.lit(None).cast("double"),
    ]
    named = [f.alias(n) for f, n in zip(figures, GAP_FEATURES, strict=True)]
    return v.select(F.col("label").cast("long").alias("cluster_id"), *x, *named)


def _gap_sql(group: str) -> str:
    g = "cluster_id, " if group else ""
    same = "AND a.cluster_id = b.cluster_id" if group else ""
    return f"""WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS cluster_id, embedding AS v FROM embeddings),
    y AS (SELECT vec_id, cluster_id, 'f' || k AS feature, v[11 + k]::DOUBLE AS y FROM e, range(4) t(k)
          WHERE k = 0 OR (k = 1 AND vec_id % 2 = 0) OR (k = 2 AND vec_id % 3 <> 0) OR (k = 3 AND vec_id % 5 <> 0)),
    x AS (SELECT y.vec_id, y.cluster_id, feature, i, v[i]::DOUBLE AS x FROM y JOIN e USING (vec_id), range(1, 7) t(i)
          UNION ALL SELECT vec_id, cluster_id, feature, 0, y FROM y),
    c AS (SELECT vec_id, {g}feature, i, x - avg(x) OVER (PARTITION BY {g}feature, i) AS x FROM x),
    s AS (SELECT {'a.cluster_id, ' if group else ''}a.feature, a.i, b.i AS j, sum(a.x * b.x) AS s, count(*) AS n
          FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.feature = b.feature {same} GROUP BY ALL)
    SELECT {g}feature, n, round(sum(s * s) FILTER (WHERE i > 0 AND j = 0)
      / (sqrt(sum(s * s) FILTER (WHERE i > 0 AND j > 0)) * sum(s) FILTER (WHERE i = 0 AND j = 0)), 6) AS cka_to_embedding
    FROM s GROUP BY {g}feature, n HAVING n >= 2"""


@query("cka_per_feature_gaps", _gap_sql(""))
def cka_per_feature_gaps(spark, sf):
    """Columns with missing values lose their own rows only; an empty column has no row."""
    got = G.feature_similarity(_gaps(spark, sf), src.REPR[:6], GAP_FEATURES)
    return rounded(got.select("feature", "n", "cka_to_embedding"), 6)


@query("cka_per_cluster_gaps", _gap_sql("cluster_id"))
def cka_per_cluster_gaps(spark, sf):
    got = G.feature_similarity(_gaps(spark, sf), src.REPR[:6], GAP_FEATURES, ["cluster_id"], min_rows=2)
    return rounded(got.select("cluster_id", "feature", "n", "cka_to_embedding"), 6)


def _block_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    a = f"a.{group}, " if group else ""
    src_g = "label % 3 AS side, " if group else ""
    return f"""WITH x0 AS (SELECT vec_id, {src_g}unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    xc AS (SELECT vec_id, {g}i, x - avg(x) OVER (PARTITION BY {g}i) AS x FROM x0),
    s AS (SELECT {a}a.i AS i, b.i AS j, sum(a.x * b.x) AS s FROM xc a JOIN xc b USING (vec_id) GROUP BY ALL),
    n AS (SELECT {g}count(DISTINCT vec_id) AS n FROM x0 {'GROUP BY ALL' if group else ''}),
    k AS (SELECT {g}sum(s * s) FILTER (WHERE i < 40 AND j >= 40) AS xy, sum(s * s) FILTER (WHERE i < 40 AND j < 40) AS xx,
                 sum(s * s) FILTER (WHERE i >= 40 AND j >= 40) AS yy FROM s {'GROUP BY ALL' if group else ''})
    SELECT {g}n AS n_merged, n AS n_samples, round(xy / (sqrt(xx) * sqrt(yy)), 6) AS cka FROM k {'JOIN n USING (' + group + ')' if group else ', n'}"""


def _blocks(spark, sf):
    v = src.vectors(spark, sf)
    cols = [F.get("vector", F.lit(i)).alias(c) for i, c in enumerate(src.REPR)]
    return v.select((F.col("cluster_id") % 3).alias("side"), *cols)


@query("cka_blocks", _block_sql(""))
def cka_blocks(spark, sf):
    return rounded(G.block_similarity(_blocks(spark, sf), src.REPR[:40], src.REPR[40:]), 6)


@query("cka_blocks_by_group", _block_sql("side"))
def cka_blocks_by_group(spark, sf):
    return rounded(G.block_similarity(_blocks(spark, sf), src.REPR[:40], src.REPR[40:], ["side"]), 6)


# ---- importance and overlays --------------------------------------------------------------

BOTH = CKA_CLUSTER + EFFECTS[len(src.FEATURE_LONG):]

LOCAL = BOTH + """,
j AS (SELECT c.cluster_id, c.feature, c.cka_to_embedding, e.cohens_d, abs(e.cohens_d) AS abs_cohens_d
      FROM cka c LEFT JOIN effects e USING (cluster_id, feature)),
m AS (SELECT *, max(cka_to_embedding) OVER q AS mc, max(abs_cohens_d) OVER q AS md FROM j WINDOW q AS (PARTITION BY cluster_id)),
nn AS (SELECT *, cka_to_embedding / CASE WHEN mc > 0 THEN mc ELSE 1 END AS norm_cka,
              abs_cohens_d / CASE WHEN md > 0 THEN md ELSE 1 END AS norm_cohen FROM m),
li AS (SELECT *, norm_cka * norm_cohen AS feature_importance FROM nn)"""
ORDER = "feature_importance DESC NULLS LAST, norm_cka DESC NULLS LAST, norm_cohen DESC NULLS LAST, feature"


@query(
    "importance_local",
    f"""WITH {LOCAL} SELECT cluster_id, feature, {r(6, 'cka_to_embedding', 'cohens_d', 'norm_cka', 'norm_cohen', 'feature_importance')},
    CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {ORDER}) AS INTEGER) AS rank FROM li""",
)
def importance_local(spark, sf):
    cka, stats = _cka_and_stats(spark, sf)
    return rounded(E.local_importance(cka, E.cohens_d(stats)).drop("abs_cohens_d"), 6)


GLOBAL = BOTH + """,
gi AS (SELECT c.cluster_id, c.feature, c.cka_to_embedding, e.cohens_d,
              c.cka_to_embedding / (SELECT greatest(max(cka_to_embedding), 1e-12) FROM cka) AS norm_cka,
              abs(e.cohens_d) / (SELECT greatest(max(abs(cohens_d)), 1e-12) FROM effects) AS norm_cohen
       FROM cka c JOIN effects e USING (cluster_id, feature)),
gs AS (SELECT *, norm_cka * norm_cohen AS feature_importance FROM gi),
gt AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY feature_importance DESC NULLS LAST, norm_cka DESC NULLS LAST, norm_cohen DESC NULLS LAST, feature) AS INTEGER) AS rank FROM gs)"""


def _global_top(spark, sf, k):
    cka, stats = _cka_and_stats(spark, sf)
    # the global maximum needs the similarity table twice
    return E.top_k_rows(E.global_importance(cut_lineage(cka, "cka"), E.cohens_d(stats)), k)


@query(
    "importance_topk",
    f"WITH {GLOBAL} SELECT cluster_id, feature, rank, {r(6, 'cka_to_embedding', 'cohens_d', 'norm_cka', 'norm_cohen', 'feature_importance')} FROM gt WHERE rank <= 4",
)
def importance_topk(spark, sf):
    return rounded(_global_top(spark, sf, 4).drop("abs_cohens_d"), 6)


@query(
    "cluster_importance",
    f"""WITH {GLOBAL} SELECT cluster_id, round(sum(feature_importance), 6) AS cluster_importance_topk_sum,
    count(feature_importance) AS n_top_features_used FROM gt WHERE rank <= 4 GROUP BY ALL""",
)
def cluster_importance(spark, sf):
    return rounded(E.cluster_importance(_global_top(spark, sf, 4)), 6)


METRICS = CKA + """,
fisher AS (SELECT feature, var_pop(mean) / (avg(var_all) + 1e-12) AS fisher_ratio, count(*) AS n_groups FROM stats GROUP BY ALL),
metrics AS (SELECT coalesce(f.feature, c.feature) AS feature, f.fisher_ratio, c.cka_to_embedding
            FROM (SELECT * FROM fisher WHERE feature <> 'value__median') f
            FULL OUTER JOIN (SELECT * FROM cka WHERE feature <> 'value__mean') c USING (feature))"""


def _metrics(spark, sf, outer=True):
    wide = _wide(spark, sf)
    fisher = E.global_fisher(_stats(spark, sf, wide)).select("feature", "fisher_ratio")
    cka = G.feature_similarity(wide, src.REPR, src.FEATURES).select("feature", "cka_to_embedding")
    if outer:
        # each side lacks one feature, so both kinds of unmatched rows occur
        fisher = fisher.filter(F.col("feature") != "value__median")
        cka = cka.filter(F.col("feature") != "value__mean")
    return E.fisher_cka_table(fisher, cka)


@query("fisher_cka_outer", f"WITH {METRICS} SELECT feature, {r(6, 'fisher_ratio', 'cka_to_embedding')} FROM metrics")
def fisher_cka_outer(spark, sf):
    return rounded(_metrics(spark, sf), 6)


ALL_METRICS = METRICS.replace(" WHERE feature <> 'value__median'", "").replace(" WHERE feature <> 'value__mean'", "")


@query(
    "filter_intersection",
    f"""WITH {ALL_METRICS}, k AS (SELECT *, row_number() OVER (ORDER BY cka_to_embedding DESC NULLS LAST, feature) AS c FROM metrics)
    SELECT feature, {r(6, 'fisher_ratio', 'cka_to_embedding')}, CAST(row_number() OVER (ORDER BY c) AS INTEGER) AS rank
    FROM k WHERE c <= 6 AND fisher_ratio >= 0.02""",
)
def filter_intersection(spark, sf):
    return rounded(E.filter_features(_metrics(spark, sf, False), "intersection", top_k=6, at_least=0.02), 6)


@query(
    "filter_fisher_min",
    f"""WITH {ALL_METRICS} SELECT feature, {r(6, 'fisher_ratio', 'cka_to_embedding')},
    CAST(row_number() OVER (ORDER BY fisher_ratio DESC, feature) AS INTEGER) AS rank FROM metrics WHERE fisher_ratio >= 0.02""",
)
def filter_fisher_min(spark, sf):
    return rounded(E.filter_features(_metrics(spark, sf, False), "fisher_min", at_least=0.02), 6)


GIVEN = ["value__maximum", "value__mean", "not_there", "value__maximum", "value__variance"]


@query(
    "filter_precomputed",
    f"""WITH {ALL_METRICS} SELECT feature, {r(6, 'fisher_ratio', 'cka_to_embedding')},
    CAST(CASE feature WHEN 'value__maximum' THEN 1 WHEN 'value__mean' THEN 2 ELSE 3 END AS INTEGER) AS rank
    FROM metrics WHERE feature IN ('value__maximum', 'value__mean', 'value__variance')""",
)
def filter_precomputed(spark, sf):
    given = spark.createDataFrame(list(enumerate(GIVEN)), "pos int, feature string")
    return rounded(E.filter_features(_metrics(spark, sf, False), "precomputed", precomputed=given), 6)


@query(
    "metric_cdf",
    f"""WITH {ALL_METRICS}, u AS (SELECT 'fisher_ratio' AS metric, fisher_ratio AS value FROM metrics UNION ALL SELECT 'cka', cka_to_embedding FROM metrics)
    SELECT metric, round(value, 6) AS value, row_number() OVER (PARTITION BY metric ORDER BY value)::DOUBLE / count(*) OVER (PARTITION BY metric) AS cdf
    FROM u WHERE value IS NOT NULL""",
)
def metric_cdf(spark, sf):
    m = _metrics(spark, sf, False)
    two = F.array(
        F.struct(F.lit("fisher_ratio").alias("metric"), F.col("fisher_ratio").alias("value")),
        F.struct(F.lit("cka").alias("metric"), F.col("cka_to_embedding").alias("value")),
    )
    return rounded(Q.cdf_table(m.select(F.inline(two)), ["metric"], "value"), 6, "value")


@query(
    "effect_rescale",
    f"""WITH {EFFECTS}, a AS (SELECT cluster_id, feature, abs(cohens_d) AS d FROM effects)
    SELECT cluster_id, feature, round(d / (SELECT greatest(max(d), 1e-3) FROM a), 6) AS by_max, round(tanh(d / 0.5), 6) AS by_tanh,
           round(tanh(d / (SELECT greatest(median(d), 1e-6) FROM a)), 6) AS by_median FROM a""",
)
def effect_rescale(spark, sf):
    e = _effects(spark, sf).select("cluster_id", "feature", "abs_cohens_d")
    for mode, d0, name in (("max", None, "by_max"), ("tanh", 0.5, "by_tanh"), ("tanh", "median", "by_median")):
        e = E.rescale_effects(e, mode, d0).withColumnRenamed("norm_cohen", name)
    return rounded(e.drop("abs_cohens_d"), 6)


KEPT = """,
feats AS (SELECT feature, row_number() OVER (ORDER BY fisher_ratio DESC, feature) AS o FROM (
  SELECT feature, var_pop(mean) / (avg(var_all) + 1e-12) AS fisher_ratio FROM stats GROUP BY ALL) WHERE fisher_ratio >= 0.02)"""


def _kept(stats):
    return E.filter_features(E.global_fisher(stats), "fisher_min", at_least=0.02).select("feature", "rank")


@query(
    "overlay_rankings",
    f"""WITH {BOTH}{KEPT},
    a AS (SELECT c.cluster_id, 'cka' AS order_type, c.feature, c.cka_to_embedding, NULL::DOUBLE AS cohens_d,
                 row_number() OVER (PARTITION BY c.cluster_id ORDER BY cka_to_embedding DESC NULLS LAST, o) AS rank FROM cka c JOIN feats USING (feature)),
    b AS (SELECT e.cluster_id, 'cohen_d' AS order_type, e.feature, NULL::DOUBLE AS cka_to_embedding, e.cohens_d,
                 row_number() OVER (PARTITION BY e.cluster_id ORDER BY abs(cohens_d) DESC, o) AS rank FROM effects e JOIN feats USING (feature))
    SELECT cluster_id, order_type, feature, {r(6, 'cka_to_embedding', 'cohens_d')}, CAST(rank AS INTEGER) AS rank
    FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 3""",
)
def overlay_rankings(spark, sf):
    cka, stats = _cka_and_stats(spark, sf)
    out = E.ranking_rows(cka, E.cohens_d(stats), _kept(stats), 3)
    return rounded(out.drop("abs_cohens_d"), 6)


@query(
    "overlay_importance",
    f"""WITH {BOTH}{KEPT},
    n AS (SELECT c.cluster_id, c.feature, c.cka_to_embedding, e.cohens_d, e.mean AS cluster_mean,
            c.cka_to_embedding / (SELECT greatest(max(cka_to_embedding), 1e-12) FROM cka JOIN feats USING (feature)) AS norm_cka,
            abs(e.cohens_d) / (SELECT greatest(max(abs(cohens_d)), 1e-3) FROM effects) AS norm_cohen
          FROM cka c JOIN feats USING (feature) LEFT JOIN effects e USING (cluster_id, feature)),
    s AS (SELECT *, norm_cka * norm_cohen AS feature_importance FROM n),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {ORDER}) AS INTEGER) AS rank FROM s)
    SELECT cluster_id, feature, rank, {r(6, 'cka_to_embedding', 'cohens_d', 'norm_cka', 'norm_cohen', 'feature_importance')}, {r(9, 'cluster_mean')} FROM k""",
)
def overlay_importance(spark, sf):
    cka, s = _cka_and_stats(spark, sf)
    got = E.overlay_importance(cut_lineage(cka, "cka"), E.cohens_d(s), _kept(s), mode="max")
    out = E.with_cluster_mean(got, s)
    return rounded(rounded(out, 9, "cluster_mean"), 6, *[f.name for f in got.schema if f.dataType.typeName() == "double"])


@query(
    "member_overlay",
    f"""WITH {EFFECTS},
    k AS (SELECT cluster_id, feature, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY abs(cohens_d) DESC, feature) AS INTEGER) AS rank FROM effects),
    x AS (SELECT feature, min(value) AS lo, CASE WHEN max(value) <= min(value) THEN min(value) + 1 ELSE max(value) END AS hi FROM long GROUP BY ALL)
    SELECT l.cluster_id, l.vec_id, l.feature, k.rank, 'cohen_d' AS order_type, round(l.value, 6) AS value,
           round(least(greatest((l.value - lo) / (hi - lo + 1e-12), 0), 1), 6) AS value_norm
    FROM long l JOIN k USING (cluster_id, feature) JOIN x USING (feature) WHERE k.rank <= 3""",
)
def member_overlay(spark, sf):
    long = src.feature_long(spark, sf)
    effects = E.cohens_d(E.cluster_stats(long))
    from pyspark.sql import Window

    w = Window.partitionBy("cluster_id").orderBy(F.col("abs_cohens_d").desc(), "feature")
    ranking = effects.select("cluster_id", "feature", F.lit("cohen_d").alias("order_type"), F.row_number().over(w).alias("rank"))
    out = E.member_overlay(X.min_max_long(long).drop("lo", "hi"), ranking.filter("rank <= 3"))
    return rounded(out, 6, "value", "value_norm")


@query(
    "member_features",
    f"""WITH {src.FEATURE_LONG} SELECT CAST(l.vec_id AS VARCHAR) AS vec_id, l.cluster_id, round(l.value__mean, 5) AS value__mean,
    round(e.embedding[1]::DOUBLE, 6) AS value__mean_repr FROM labelled l JOIN embeddings e ON e.vec_id = l.vec_id""",
)
def member_features(spark, sf):
    left = src.labelled_features(spark, sf).select("vec_id", "cluster_id", "value__mean")
    right = src.vectors(spark, sf).select("vec_id", F.get("vector", F.lit(0)).alias("value__mean"))
    out = K.prefixed_join(left, right, ["vec_id"])
    return rounded(rounded(out, 5, "value__mean"), 6, "value__mean_repr")


@query(
    "dedup_join",
    """WITH e AS (SELECT user_id, first(event_type ORDER BY event_id) AS event_type, first(value ORDER BY event_id) AS value FROM events GROUP BY ALL),
    v AS (SELECT label AS user_id, first(vec_id ORDER BY vec_id) AS vec_id FROM embeddings GROUP BY ALL),
    s AS (SELECT s_nationkey AS user_id, first(s_name ORDER BY s_suppkey) AS s_name FROM supplier GROUP BY ALL)
    SELECT user_id, event_type, value, vec_id, s_name FROM e JOIN v USING (user_id) JOIN s USING (user_id)""",
)
def dedup_join(spark, sf):
    e = src.table(spark, sf, "events", "user_id", "event_id", "event_type", "value")
    v = src.vectors(spark, sf).select(F.col("cluster_id").cast("long").alias("user_id"), "vec_id")
    s = src.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("user_id"), "s_suppkey", "s_name")
    got = K.dedup_join([e, v, s], ["user_id"], [["event_id"], ["vec_id"], ["s_suppkey"]])
    return got.select("user_id", "event_type", "value", "vec_id", "s_name")


@query(
    "left_join_checked",
    f"""WITH {src.USER_FEATURES} SELECT e.vec_id, e.label AS cluster_id, round(u.value__mean, 5) AS value__mean
    FROM embeddings e LEFT JOIN user_features u USING (vec_id)""",
)
def left_join_checked(spark, sf):
    left = src.vectors(spark, sf).select("vec_id", "cluster_id")
    out = K.left_join_unique(left, src.user_features(spark, sf).select("vec_id", "value__mean"), ["vec_id"])
    return rounded(out, 5, "value__mean")


MEMBERS = src.BURSTS + """,
members AS (SELECT label AS member_group, CAST(vec_id AS VARCHAR) AS user_id FROM embeddings),
have AS (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) FILTER (WHERE vin > 0) AS n, sum(vin)::DOUBLE AS total FROM series GROUP BY ALL)"""


def _members(spark, sf):
    m = src.vectors(spark, sf).select(F.col("cluster_id").alias("member_group"), F.col("vec_id").alias("user_id"))
    padded = src.series(spark, sf).select(
        "user_id", F.transform("inbound", lambda x: F.when(x == 0, F.lit(-1.0)).otherwise(x)).alias("series")
    )
    return K.member_lookup(m, padded, ["user_id"], "series", ["user_id"])


@query(
    "member_lookup",
    f"""WITH {MEMBERS} SELECT m.member_group, m.user_id, h.user_id IS NOT NULL AS found, CAST(h.n AS INTEGER) AS n, h.total
    FROM members m LEFT JOIN have h USING (user_id)""",
)
def member_lookup(spark, sf):
    got = _members(spark, sf)
    return got.select(
        "member_group", "user_id", "found", F.when(F.col("found"), F.size("series")).alias("n"),
        F.aggregate("series", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    "member_counts",
    f"""WITH {MEMBERS}, f AS (SELECT m.member_group, (h.user_id IS NOT NULL)::INT AS x FROM members m LEFT JOIN have h USING (user_id))
    SELECT member_group, CAST(sum(x) AS BIGINT) AS found, CAST(sum(1 - x) AS BIGINT) AS missing FROM f GROUP BY ROLLUP (member_group)""",
)
def member_counts(spark, sf):
    return K.member_counts(_members(spark, sf), "member_group")


@query(
    "member_lists",
    "SELECT 'group_' || event_type AS member_group, count(*) AS n, count(DISTINCT user_id) AS n_ids FROM events GROUP BY ALL",
)
def member_lists(spark, sf):
    """Id lists written as JSON, one folder per group, and read back with their folder name."""
    from burstseries.sources.files import scan_member_lists

    path = fresh_path(spark, "members")
    ev = src.table(spark, sf, "events", "event_type", "user_id", "event_id")
    # a list holds at most a thousand ids, however often one of them occurs
    lists = ev.groupBy("event_type", F.floor(F.col("event_id") / 1000)).agg(
        F.to_json(F.collect_list(F.struct(F.col("user_id").cast("string").alias("user_id")))).alias("value")
    )
    lists.select("value", "event_type").write.partitionBy("event_type").text(path)
    back = scan_member_lists(spark, path, ["user_id"], one_per_file=False)
    group = F.replace("member_group", F.lit("event_type="), F.lit("group_")).alias("member_group")
    return back.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_ids"))


# ---- geometry -----------------------------------------------------------------------------


def _geometry_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    return f"""WITH n0 AS (SELECT vec_id, label AS cluster_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings),
    u AS (SELECT vec_id, cluster_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE / l AS u FROM n0),
    s AS (SELECT {g}d, sum(u) AS su, avg(abs(u)) AS w, count(*) AS n FROM u GROUP BY ALL)
    SELECT {g}max(n) AS n_samples, CAST(count(*) AS INTEGER) AS n_dims, round((sum(su * su) - max(n)) / (max(n)::DOUBLE * (max(n) - 1)), 8) + 0.0 AS mean_pairwise_cosine,
           round(max(w), 8) AS dominant_weight, CAST(max_by(d, w) AS INTEGER) AS dominant_dim FROM s {'GROUP BY ' + group if group else ''}"""


@query("direction_stats", _geometry_sql(""))
def direction_stats(spark, sf):
    return rounded(G.direction_stats(src.vectors(spark, sf), [], "vector"), 8)


@query("direction_stats_grouped", _geometry_sql("cluster_id"))
def direction_stats_grouped(spark, sf):
    return rounded(G.direction_stats(src.vectors(spark, sf), ["cluster_id"], "vector"), 8)


@query("spectrum_stats")
def spectrum_stats(spark, sf):
    return rounded(G.spectrum_stats(src.vectors(spark, sf), [], "vector"), 8)


@query("spectrum_stats_grouped")
def spectrum_stats_grouped(spark, sf):
    return rounded(G.spectrum_stats(src.vectors(spark, sf), ["cluster_id"], "vector"), 8)


def _aligned(spark, sf):
    feats = src.labelled_features(spark, sf)
    both = feats.join(src.vectors(spark, sf).select("vec_id", "vector"), "vec_id")
    return G.component_alignment(both, "vector", src.FEATURES, ["vec_id"])


@query("component_alignment")
def component_alignment(spark, sf):
    return rounded(_aligned(spark, sf), 6)


@query("alignment_top")
def alignment_top(spark, sf):
    return rounded(G.correlation_filter(_aligned(spark, sf), top_k=3), 6)


@query(
    "correlation_filter",
    f"""WITH {src.FEATURE_LONG},
    x AS (SELECT feature, covar_pop(l.value, e.embedding[1]::DOUBLE) / nullif(stddev_pop(l.value) * stddev_pop(e.embedding[1]::DOUBLE), 0) AS c, count(*) AS n FROM long l JOIN embeddings e USING (vec_id) GROUP BY ALL),
    k AS (SELECT feature, n, abs(c) AS abs_corr FROM x WHERE abs(c) >= 0.01)
    SELECT feature, n, round(abs_corr, 6) AS abs_corr, CAST(row_number() OVER (ORDER BY abs_corr DESC, n DESC, feature) AS INTEGER) AS rank FROM k""",
)
def correlation_filter(spark, sf):
    long = src.feature_long(spark, sf)
    lead = src.vectors(spark, sf).select("vec_id", F.get("vector", F.lit(0)).alias("x"))
    c = long.join(lead, "vec_id").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), G.pearson("x", "value").alias("c")
    )
    table = c.select("feature", "n", F.abs("c").alias("abs_corr"))
    return rounded(G.correlation_filter(table, at_least=0.01), 6)

