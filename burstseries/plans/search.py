"""Queries over retrieval, series distances, forecasts, model hooks, streams and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstseries.functions.arrays import item_rows
from burstseries.operators import distances as D
from burstseries.operators import features as X
from burstseries.operators import forecast as P
from burstseries.operators import retrieval as R
from burstseries.operators import tokens as T
from burstseries.plans import inputs as src
from burstseries.plans.analysis import r, rounded
from burstseries.plans.registry import query
from burstseries.plans.traffic import SESSIONS
from burstseries.session import cut_lineage, fresh_path
from burstseries.streaming import incremental as ST

# ---- retrieval ----------------------------------------------------------------------------

EVAL = 0.1

MANIFEST = """
unitv AS (
  SELECT vec_id, label AS cluster_id,
         list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v
  FROM embeddings),
ordered AS (SELECT *, row_number() OVER (ORDER BY md5('42_' || vec_id), vec_id) AS rn, count(*) OVER () AS n FROM unitv),
manifest AS (
  SELECT CAST(vec_id AS VARCHAR) || '::' || cluster_id AS point_id, vec_id, cluster_id, v,
         CASE WHEN rn <= round(n * 0.1) THEN -1 ELSE CAST(rn - round(n * 0.1) - 1 AS BIGINT) END AS train_id,
         CASE WHEN rn <= round(n * 0.1) THEN 'eval' ELSE 'train' END AS split FROM ordered),
q AS (SELECT * FROM manifest WHERE split = 'eval'),
b AS (SELECT * FROM manifest WHERE split = 'train')"""


def _points(spark, sf):
    v = src.vectors(spark, sf).withColumnRenamed("cluster_id", "label")
    manifest = R.split_manifest(v, ["vec_id", "label"], "vec_id", "label", fraction=EVAL)
    unit = R.unit_vectors(v.select("vec_id", "vector"), "vector")
    return manifest.select("point_id", "vec_id", "train_id", "cluster_id", "split").join(unit, "vec_id")


def _sides(spark, sf):
    p = cut_lineage(_points(spark, sf), "points")
    queries = p.filter("split = 'eval'").select(F.col("vec_id").alias("query_id"), "cluster_id", "vector")
    base = p.filter("split = 'train'").select(F.col("vec_id").alias("base_id"), "cluster_id", "vector")
    return queries, base


@query("retrieval_manifest", f"WITH {MANIFEST} SELECT point_id, vec_id, train_id, cluster_id, split FROM manifest")
def retrieval_manifest(spark, sf):
    return _points(spark, sf).drop("vector")


@query(
    "vector_norms",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS raw_sq, 1.0::DOUBLE AS unit_sq FROM embeddings""",
)
def vector_norms(spark, sf):
    v = src.vectors(spark, sf)
    unit = R.unit_vectors(v.withColumn("raw", F.col("vector")), "vector")
    sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    return unit.select("vec_id", F.round(sq("raw"), 6).alias("raw_sq"), F.round(sq("vector"), 6).alias("unit_sq"))


KNN = MANIFEST + """,
knn AS (
  SELECT q.vec_id AS query_id, b.vec_id AS base_id, list_dot_product(q.v, b.v) AS score, b.cluster_id AS base_cluster,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, b.v) DESC, b.vec_id) AS rank FROM q, b)"""


@query("knn_exact_topk", f"WITH {KNN} SELECT query_id, base_id, round(score, 8) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank <= 5")
def knn_exact_topk(spark, sf):
    queries, base = _sides(spark, sf)
    return rounded(R.exact_search(queries, base, 5), 8)


@query(
    "knn_exact_blocks",
    f"WITH {KNN} SELECT query_id, base_id, round(score, 8) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM knn WHERE rank <= 3",
)
def knn_exact_blocks(spark, sf):
    """The same search in block cells, as for a query side too large to broadcast."""
    queries, base = _sides(spark, sf)
    return rounded(R.exact_search(queries, base, 3, block_rows=100, broadcast_bytes=0), 8)


CLUSTER_KNN = MANIFEST + """,
cknn AS (
  SELECT q.cluster_id, q.vec_id AS query_id, b.vec_id AS base_id, list_dot_product(q.v, b.v) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, b.v) DESC, b.vec_id) AS rank
  FROM q JOIN b USING (cluster_id))"""


@query("knn_cluster_topk", f"WITH {CLUSTER_KNN} SELECT cluster_id, query_id, base_id, round(score, 8) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM cknn WHERE rank <= 3")
def knn_cluster_topk(spark, sf):
    queries, base = _sides(spark, sf)
    return rounded(R.cluster_search(queries, base, 3), 8)


# lists whose centres are the label means, so that the search has an exact SQL twin
LISTS = MANIFEST + """,
mid AS (SELECT cluster_id AS list_id, d, avg(x) AS m FROM (SELECT cluster_id, unnest(range(64)) AS d, unnest(v) AS x FROM b) GROUP BY ALL),
lists AS (SELECT list_id, list(m ORDER BY d) AS c FROM mid GROUP BY ALL),
owner AS (SELECT vec_id, max_by(list_id, s) AS list_id FROM (SELECT b.vec_id, l.list_id, list_dot_product(b.v, l.c) AS s FROM b, lists l) GROUP BY ALL),
probe AS (SELECT q.vec_id AS query_id, l.list_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, l.c) DESC, l.list_id) AS probe_rank FROM q, lists l),
cand AS (
  SELECT p.query_id, b.vec_id AS base_id, b.cluster_id AS base_cluster, p.list_id, p.probe_rank, list_dot_product(q.v, b.v) AS score
  FROM probe p JOIN q ON q.vec_id = p.query_id JOIN owner o USING (list_id) JOIN b ON b.vec_id = o.vec_id)"""


def _lists(base):
    dims = item_rows(base, ["cluster_id"], "vector", "d", "x").groupBy("cluster_id", "d").agg(F.avg("x").alias("m"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda c: c["m"])
    return cut_lineage(dims.groupBy(F.col("cluster_id").alias("list_id")).agg(packed.alias("vector")), "lists")


def _index(spark, sf):
    queries, base = _sides(spark, sf)
    lists = _lists(base)
    return queries, cut_lineage(R.assign_lists(base, lists), "index"), lists


@query(
    "ivf_search",
    f"""WITH {LISTS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank FROM cand WHERE probe_rank <= 3)
    SELECT query_id, base_id, list_id, CAST(probe_rank AS INTEGER) AS probe_rank, round(score, 8) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 4""",
)
def ivf_search(spark, sf):
    queries, assigned, lists = _index(spark, sf)
    return rounded(R.search_lists(queries, assigned, lists, 4, 3), 8)


@query(
    "ivf_search_in_cluster",
    f"""WITH {LISTS}, k AS (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base_id) AS rank
      FROM cand c JOIN q ON q.vec_id = c.query_id AND q.cluster_id = c.base_cluster WHERE probe_rank <= 5)
    SELECT query_id, base_id, round(score, 8) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 2""",
)
def ivf_search_in_cluster(spark, sf):
    queries, assigned, lists = _index(spark, sf)
    got = R.search_lists(queries, assigned, lists, 2, 5, cluster="cluster_id")
    return rounded(got.select("query_id", "base_id", "score", "rank"), 8)


PROBES = [1, 3, 10]
GRID = LISTS + """,
g AS (SELECT query_id, n, max_by(base_id, score) AS neighbor_id, max_by(base_cluster, score) AS neighbor_cluster
      FROM cand, (SELECT unnest([1, 3, 10]) AS n) WHERE probe_rank <= n GROUP BY ALL),
grid AS (SELECT q.vec_id AS query_id, p.n AS n_probe, coalesce(g.neighbor_id, -1) AS neighbor_id, coalesce(g.neighbor_cluster, -1) AS neighbor_cluster
         FROM q CROSS JOIN (SELECT unnest([1, 3, 10]) AS n) p LEFT JOIN g ON g.query_id = q.vec_id AND g.n = p.n)"""


def _grid(spark, sf):
    queries, assigned, lists = _index(spark, sf)
    return cut_lineage(R.probe_grid(queries, assigned, lists, [1, 3, 3, 10, 0]), "grid")


@query("probe_grid", f"WITH {GRID} SELECT query_id, n_probe, neighbor_id, neighbor_cluster FROM grid")
def probe_grid(spark, sf):
    return _grid(spark, sf)


@query(
    "probe_changes",
    f"""WITH {GRID}, c AS (SELECT a.n_probe, count(*) AS total_queries, CAST(sum((a.neighbor_cluster <> x.neighbor_cluster)::INT) AS BIGINT) AS cluster_changed,
      CAST(sum((a.neighbor_id <> x.neighbor_id)::INT) AS BIGINT) AS neighbor_changed FROM grid a JOIN grid x ON x.query_id = a.query_id AND x.n_probe = 1 GROUP BY a.n_probe)
    SELECT n_probe, total_queries, cluster_changed, neighbor_changed, CAST(1 AS INTEGER) AS n_probe_ref,
           round(100.0::DOUBLE * cluster_changed / total_queries, 4) AS cluster_changed_pct, round(100.0::DOUBLE * neighbor_changed / total_queries, 4) AS neighbor_changed_pct FROM c""",
)
def probe_changes(spark, sf):
    return R.probe_changes(_grid(spark, sf), 1)


@query(
    "probe_comparison",
    f"""WITH {GRID} SELECT query_id, max(neighbor_id) FILTER (WHERE n_probe = 1) AS neighbor_id_nprobe_1, max(neighbor_cluster) FILTER (WHERE n_probe = 1) AS retrieved_cluster_nprobe_1,
    max(neighbor_id) FILTER (WHERE n_probe = 10) AS neighbor_id_nprobe_10, max(neighbor_cluster) FILTER (WHERE n_probe = 10) AS retrieved_cluster_nprobe_10,
    max(neighbor_cluster) FILTER (WHERE n_probe = 1) <> max(neighbor_cluster) FILTER (WHERE n_probe = 10) AS cluster_changed,
    max(neighbor_id) FILTER (WHERE n_probe = 1) <> max(neighbor_id) FILTER (WHERE n_probe = 10) AS neighbor_changed FROM grid GROUP BY ALL""",
)
def probe_comparison(spark, sf):
    return R.compare_probes(_grid(spark, sf), 1, 10)


@query("ivf_trained_recall")
def ivf_trained_recall(spark, sf):
    """Lists trained by k-means and stored by list; share of exact neighbours found per probe count."""
    queries, base = _sides(spark, sf)
    lists = R.train_lists(base, 16, max_iter=10)
    path = fresh_path(spark, "ivf")
    R.write_index(R.assign_lists(base, lists), path)
    assigned = spark.read.parquet(path)
    grid = R.probe_grid(queries, assigned, lists, [1, 4, 16])
    exact = R.exact_search(queries, base, 1).select("query_id", "base_id")
    hit = (F.col("neighbor_id") == F.col("base_id")).cast("double")
    return grid.join(exact, "query_id").groupBy("n_probe").agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(hit), 6).alias("recall")
    )


# ---- distances ----------------------------------------------------------------------------

DAILY = src.EVENTS + """,
daily AS (SELECT user_id, second // 86400 AS bin, CAST(sum(cents) AS BIGINT) AS v FROM ev GROUP BY ALL),
dspan AS (SELECT user_id, min(bin) AS b0, unnest(range(min(bin), max(bin) + 1)) AS b FROM daily GROUP BY user_id),
dseries AS (SELECT s.user_id, s.b - s.b0 AS i, CASE WHEN d.v >= 1000 THEN d.v ELSE 0 END::DOUBLE AS v
            FROM dspan s LEFT JOIN daily d ON d.user_id = s.user_id AND d.bin = s.b)"""

PAIRS = MANIFEST + "," + DAILY + """,
hits AS (
  SELECT q.vec_id AS test_id, b.vec_id AS neighbor, q.cluster_id,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, b.v) DESC, b.vec_id) AS rank
  FROM q JOIN b USING (cluster_id)),
pairs AS (SELECT * FROM hits WHERE rank <= 3),
joined AS (
  SELECT p.test_id, p.rank, x.i, x.v AS a, y.v AS b FROM pairs p
  JOIN dseries x ON x.user_id = p.test_id JOIN dseries y ON y.user_id = p.neighbor AND y.i = x.i),
wn AS (SELECT test_id, rank, i, greatest(a, 0) + 1e-20 AS a, CASE WHEN a <= 0 THEN 0 ELSE b END + 1e-20 AS b FROM joined),
cdf AS (SELECT test_id, rank, i, sum(a) OVER w / sum(a) OVER u AS ca, sum(b) OVER w / sum(b) OVER u AS cb, max(i) OVER u AS last
        FROM wn WINDOW w AS (PARTITION BY test_id, rank ORDER BY i), u AS (PARTITION BY test_id, rank)),
wd_n AS (SELECT test_id, rank, coalesce(sum(abs(ca - cb)) FILTER (WHERE i < last), 0) AS wn FROM cdf GROUP BY ALL),
sorted AS (SELECT test_id, rank, row_number() OVER (PARTITION BY test_id, rank ORDER BY a) AS k, a FROM joined),
sorted2 AS (SELECT test_id, rank, row_number() OVER (PARTITION BY test_id, rank ORDER BY b) AS k, b FROM joined),
wd_u AS (SELECT test_id, rank, avg(abs(a - b)) AS wu FROM sorted JOIN sorted2 USING (test_id, rank, k) GROUP BY ALL)"""


def daily_series(spark, sf):
    from burstseries.operators.dense import dense_series

    ev = src.events(spark, sf, "user_id", "second", "cents")
    bins = ev.groupBy("user_id", F.floor(F.col("second") / 86_400).cast("long").alias("bin")).agg(
        F.sum("cents").alias("v")
    )
    return dense_series(
        bins, ["user_id"], {"series": "v"}, threshold=1000, min_len=1, item_type="double"
    )


def _distance_rows(spark, sf):
    queries, base = _sides(spark, sf)
    hits = R.cluster_search(queries, base, 3)
    slots = R.padded_neighbors(queries.select("query_id", "cluster_id"), cut_lineage(hits, "hits"), 3, "query_id", "base_id")
    named = slots.join(queries.select("query_id", "cluster_id"), "query_id").select(
        F.col("query_id").cast("string").alias("test_point_id"),
        F.col("base_id").cast("string").alias("neighbor_id"),
        "cluster_id",
        "rank",
        "neighbor_count",
    )
    series = daily_series(spark, sf).select(F.col("user_id").cast("string").alias("point_id"), "series")
    return D.distance_rows(named, series)


@query(
    "wasserstein_pairs",
    f"""WITH {PAIRS} SELECT CAST(p.test_id AS VARCHAR) AS test_point_id, CAST(p.neighbor AS VARCHAR) AS neighbor_id, CAST(p.rank AS INTEGER) AS rank, p.cluster_id,
    round(n.wn, 6) + 0.0 AS wasserstein_distance_normalized, round(u.wu, 3) + 0.0 AS wasserstein_distance_unnormalized
    FROM pairs p LEFT JOIN wd_n n USING (test_id, rank) LEFT JOIN wd_u u USING (test_id, rank)""",
)
def wasserstein_pairs(spark, sf):
    out = _distance_rows(spark, sf).select(
        "test_point_id", "neighbor_id", "rank", "cluster_id", "wasserstein_distance_normalized",
        "wasserstein_distance_unnormalized",
    )
    return rounded(rounded(out, 6, "wasserstein_distance_normalized"), 3, "wasserstein_distance_unnormalized")


DTW = PAIRS + """,
masked AS (SELECT test_id, rank, i, CASE WHEN a <= 0 THEN 0 ELSE a END AS a, CASE WHEN a <= 0 THEN 0 ELSE b END AS b FROM joined),
st AS (SELECT test_id, rank, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM masked GROUP BY ALL),
z AS (SELECT test_id, rank, list(CASE WHEN sa < 1e-12 THEN 0.0 ELSE (a - ma) / sa END ORDER BY i) AS za,
             list(CASE WHEN sb < 1e-12 THEN 0.0 ELSE (b - mb) / sb END ORDER BY i) AS zb
      FROM masked JOIN st USING (test_id, rank) GROUP BY ALL),
raw AS (SELECT test_id, rank, list(greatest(a / 1e6, 0) ORDER BY i) AS za, list(greatest(b / 1e6, 0) ORDER BY i) AS zb FROM joined GROUP BY ALL),
arms AS (SELECT 'n' AS mode, * FROM z UNION ALL SELECT 'u', * FROM raw)"""

DTW_SQL = f"""WITH RECURSIVE {DTW},
    dp AS (
      SELECT mode, test_id, rank, za, zb, 0 AS i, list_concat([0.0::DOUBLE], list_transform(range(1, len(zb) + 1), lambda k: 'inf'::DOUBLE)) AS line FROM arms
      UNION ALL
      SELECT mode, test_id, rank, za, zb, i + 1, list_reduce(list_transform(range(1, len(zb) + 1), lambda j: [j::DOUBLE]),
               lambda acc, j: list_append(acc, abs(za[i + 1] - zb[j[1]::BIGINT]) + least(line[j[1]::BIGINT + 1], acc[len(acc)], line[j[1]::BIGINT])), ['inf'::DOUBLE])
      FROM dp WHERE i < len(za)),
    d AS (SELECT test_id, rank, max(line[len(line)]) FILTER (WHERE mode = 'n') AS dn, max(line[len(line)]) FILTER (WHERE mode = 'u') AS du
          FROM dp WHERE i = len(za) GROUP BY ALL)
    SELECT CAST(p.test_id AS VARCHAR) AS test_point_id, CAST(p.rank AS INTEGER) AS rank, round(dn, 6) + 0.0 AS dtw_distance_normalized, round(du, 6) + 0.0 AS dtw_distance_unnormalized
    FROM pairs p LEFT JOIN d USING (test_id, rank)"""


@query("dtw_pairs", DTW_SQL)
def dtw_pairs(spark, sf):
    out = _distance_rows(spark, sf).select(
        "test_point_id", "rank", "dtw_distance_normalized", "dtw_distance_unnormalized"
    )
    return rounded(out, 6)


@query(
    "distance_sanity",
    f"""WITH {PAIRS}, c AS (SELECT test_id, count(*) AS k FROM pairs GROUP BY ALL),
    f AS (SELECT p.test_id, p.test_id IN (SELECT user_id FROM dseries) AS e, p.neighbor IN (SELECT user_id FROM dseries) AS h FROM pairs p)
    SELECT (SELECT count(*) FROM q) AS n_queries, (SELECT count(*) * 3 FROM q) AS n_rows,
           count(*) FILTER (WHERE e AND h) AS finite_wasserstein_distance_normalized, count(*) FILTER (WHERE e AND h) AS finite_dtw_distance_normalized,
           (SELECT count(*) FROM q WHERE vec_id NOT IN (SELECT user_id FROM dseries)) AS missing_eval_series,
           count(*) FILTER (WHERE e AND NOT h) AS missing_neighbor_series, (SELECT count(*) * 3 FROM q) - count(*) AS padded_slots FROM f""",
)
def distance_sanity(spark, sf):
    return R.sanity_report(
        _distance_rows(spark, sf), ["wasserstein_distance_normalized", "dtw_distance_normalized"]
    )


# ---- forecasts ----------------------------------------------------------------------------


def _cases(spark, sf):
    sp = src.splits(spark, sf)
    arr = lambda c: F.col(c).cast("array<double>")
    return sp.select(
        "user_id", arr("context_bi").alias("context_bi"), arr("context_ibg").alias("context_ibg"),
        arr("forecast_bi").alias("gt_bi"), arr("forecast_ibg").alias("gt_ibg"),
    )


FORECAST = src.SPLITS + """,
parts AS (SELECT s.user_id, b.pos - s.context_len AS k, b.bi::DOUBLE AS bi, b.ibg::DOUBLE AS ibg FROM splits s JOIN bursts b USING (user_id)),
last AS (SELECT user_id, max_by(bi, k) AS lbi, max_by(ibg, k) AS libg FROM parts WHERE k < 0 GROUP BY ALL),
cmp AS (SELECT p.user_id, p.k, p.bi AS gb, p.ibg AS gi, l.lbi AS fb, l.libg AS fi FROM parts p JOIN last l USING (user_id) WHERE k >= 0)"""


def _w1_sql(name, rows, gt, pr, thr, eps="1e-2"):
    """CTEs giving ``name(user_id, wd)`` for the rows' truth and prediction columns."""
    return f"""
{name}_w AS (SELECT user_id, k, CASE WHEN {gt} <= {thr} THEN 0 ELSE {gt} END + {eps} AS a, CASE WHEN {gt} <= {thr} THEN 0 ELSE greatest({pr}, 0) END + {eps} AS b FROM {rows}),
{name}_c AS (SELECT user_id, k, sum(a) OVER w / sum(a) OVER u AS ca, sum(b) OVER w / sum(b) OVER u AS cb, max(k) OVER u AS last
   FROM {name}_w WINDOW w AS (PARTITION BY user_id ORDER BY k), u AS (PARTITION BY user_id)),
{name} AS (SELECT user_id, coalesce(sum(abs(ca - cb)) FILTER (WHERE k < last), 0) AS wd FROM {name}_c GROUP BY ALL)"""


METRIC_CTES = FORECAST + f""",{_w1_sql('wb', 'cmp', 'gb', 'fb', 0)},{_w1_sql('wi', 'cmp', 'gi', 'fi', 0)},
fano AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE k < 0) >= 2 THEN var_pop(bi) FILTER (WHERE k < 0) / avg(bi) FILTER (WHERE k < 0) END AS fano_input_bi,
  CASE WHEN count(*) FILTER (WHERE k >= 0) >= 2 THEN var_pop(bi) FILTER (WHERE k >= 0) / avg(bi) FILTER (WHERE k >= 0) END AS fano_gt_bi FROM parts GROUP BY ALL),
per AS (
  SELECT user_id, avg(abs(fb - gb)) AS MAE_BI, avg(abs(fb - gb)) FILTER (WHERE gb > 0) AS NZ_MAE_BI,
         avg(abs(fb / 1e3 - gb / 1e3) / (gb / 1e3 + 1e-12)) FILTER (WHERE gb > 0) AS NZ_SCALED_BI,
         avg(abs(fi - gi)) AS MAE_IBG, avg(abs(fi - gi)) FILTER (WHERE gi > 0) AS NZ_MAE_IBG,
         avg(abs(fi / 1e3 - gi / 1e3) / (gi / 1e3 + 1e-12)) FILTER (WHERE gi > 0) AS NZ_SCALED_IBG,
         avg(abs((gb - fb) / gb)) FILTER (WHERE abs(gb) > 0.5) * 100 AS PERCENT_MAPE FROM cmp GROUP BY ALL)"""
METRICS = ["MAE_BI", "NZ_MAE_BI", "NZ_SCALED_BI", "MAE_IBG", "NZ_MAE_IBG", "NZ_SCALED_IBG"]


@query(
    "forecast_metrics",
    f"""WITH {METRIC_CTES} SELECT user_id, {r(5, *METRICS, 'PERCENT_MAPE')}, round(wb.wd, 6) + 0.0 AS WD_BI, round(wi.wd, 6) + 0.0 AS WD_IBG,
    {r(4, 'fano_input_bi', 'fano_gt_bi')} FROM per JOIN wb USING (user_id) JOIN wi USING (user_id) JOIN fano USING (user_id)""",
)
def forecast_metrics(spark, sf):
    cases = P.predict_last(_cases(spark, sf))
    per = P.burst_metrics(
        cases.withColumn("PERCENT_MAPE", P.percent_mape(F.col("pred_bi"), F.col("gt_bi"))),
        ["user_id", "PERCENT_MAPE"], scale=1e3,
    )
    out = per.select("user_id", *METRICS, "PERCENT_MAPE", "WD_BI", "WD_IBG", "fano_input_bi", "fano_gt_bi")
    out = rounded(rounded(out, 5, *METRICS, "PERCENT_MAPE"), 6, "WD_BI", "WD_IBG")
    return rounded(out, 4, "fano_input_bi", "fano_gt_bi")


THRESHOLDED = FORECAST + """,
t AS (SELECT user_id, k, CASE WHEN gb < 5000 THEN 0 ELSE gb END AS gb, CASE WHEN fb < 5000 THEN 0 ELSE fb END AS fb FROM cmp)"""


@query(
    "forecast_threshold",
    f"""WITH {THRESHOLDED} SELECT user_id, round(avg(abs(fb - gb)), 5) AS MAE_BI, round(avg(abs(fb - gb)) FILTER (WHERE gb > 0), 5) AS NZ_MAE_BI
    FROM t GROUP BY user_id HAVING max(gb) > 0""",
)
def forecast_threshold(spark, sf):
    per = P.burst_metrics(P.predict_last(_cases(spark, sf)), ["user_id"], threshold=5000.0)
    return rounded(per.select("user_id", "MAE_BI", "NZ_MAE_BI"), 5)


def _expand_sql(name, gap, val, limit=True):
    """CTE ``name(user_id, k, v)``: the timeline of the first bursts the truth needs (all of them here)."""
    return f"""
{name}_r AS (SELECT user_id, k, greatest(1, {gap}) AS g, {val} AS v, sum(greatest(1, {gap})) OVER (PARTITION BY user_id ORDER BY k) AS e FROM cmp),
{name} AS (SELECT user_id, CAST(t AS BIGINT) AS k, CASE WHEN t = e - 1 THEN v ELSE 0 END AS v FROM (
  SELECT user_id, e, v, unnest(range(CAST(e - g AS BIGINT), CAST(e AS BIGINT))) AS t FROM {name}_r))"""


def _line_sql(name, pred):
    return f"""
{name} AS (SELECT user_id, k, g.v AS gt, p.v AS pr FROM xg g JOIN {pred} p USING (user_id, k))"""


MERGED = (
    FORECAST + "," + _expand_sql("xg", "gi", "gb") + "," + _expand_sql("xf", "fi", "fb") + ","
    + _expand_sql("xoi", "gi", "fb") + "," + _expand_sql("xob", "fi", "gb") + ","
    + _line_sql("lf", "xf") + "," + _line_sql("loi_all", "xoi") + "," + _line_sql("lob_all", "xob") + """,
lm AS (SELECT user_id, count(*) AS lm FROM lf GROUP BY ALL),
loi AS (SELECT l.* FROM loi_all l JOIN lm USING (user_id) WHERE k < lm),
lob AS (SELECT l.* FROM lob_all l JOIN lm USING (user_id) WHERE k < lm),
swf AS (SELECT user_id, k, pr AS gt, gt AS pr FROM lf),
swoi AS (SELECT user_id, k, pr AS gt, gt AS pr FROM loi),
swob AS (SELECT user_id, k, pr AS gt, gt AS pr FROM lob),"""
    + _w1_sql("wf", "swf", "gt", "pr", 0) + "," + _w1_sql("woi", "swoi", "gt", "pr", 0) + "," + _w1_sql("wob", "swob", "gt", "pr", 0)
)
MERGED_COLS = ["MAE_EXPANDED_MERGED", "NZ_SCALED_MERGED"]
ORACLE_COLS = ["MAPE_ORACLE_IBG", "MAPE_ORACLE_BI"]


@query(
    "merged_metrics",
    f"""WITH {MERGED},
    m AS (SELECT user_id, avg(abs(pr - gt)) AS MAE_EXPANDED_MERGED, avg(abs(pr - gt) / (gt + 1e-12)) FILTER (WHERE gt > 0) AS NZ_SCALED_MERGED FROM lf GROUP BY ALL),
    full_n AS (SELECT user_id, CAST(count(*) AS INTEGER) AS merged_len FROM xg GROUP BY ALL), kk AS (SELECT user_id, CAST(count(*) AS INTEGER) AS bursts_used FROM cmp GROUP BY ALL)
    SELECT user_id, merged_len, bursts_used, {r(4, *MERGED_COLS)}, round(wf.wd, 5) + 0.0 AS WD_EXPANDED_MERGED
    FROM m JOIN full_n USING (user_id) JOIN kk USING (user_id) JOIN wf USING (user_id)""",
)
def merged_metrics(spark, sf):
    per = P.merged_metrics(P.predict_last(_cases(spark, sf)), ["user_id"])
    out = per.select("user_id", "merged_len", "bursts_used", *MERGED_COLS, "WD_EXPANDED_MERGED")
    return rounded(rounded(out, 4, *MERGED_COLS), 5, "WD_EXPANDED_MERGED")


@query(
    "oracle_split_metrics",
    f"""WITH {MERGED},
    a AS (SELECT user_id, avg(abs(pr - gt) / (gt + 1e-12)) FILTER (WHERE gt > 0) AS MAPE_ORACLE_IBG FROM loi GROUP BY ALL),
    b AS (SELECT user_id, avg(abs(pr - gt) / (gt + 1e-12)) FILTER (WHERE gt > 0) AS MAPE_ORACLE_BI FROM lob GROUP BY ALL)
    SELECT user_id, {r(4, *ORACLE_COLS)}, round(woi.wd, 5) + 0.0 AS WD_ORACLE_IBG, round(wob.wd, 5) + 0.0 AS WD_ORACLE_BI
    FROM a JOIN b USING (user_id) JOIN woi USING (user_id) JOIN wob USING (user_id)""",
)
def oracle_split_metrics(spark, sf):
    per = P.merged_metrics(P.predict_last(_cases(spark, sf)), ["user_id"])
    out = per.select("user_id", *ORACLE_COLS, "WD_ORACLE_IBG", "WD_ORACLE_BI")
    return rounded(rounded(out, 4, *ORACLE_COLS), 5, "WD_ORACLE_IBG", "WD_ORACLE_BI")


@query(
    "forecast_report",
    f"""WITH {METRIC_CTES}
    SELECT count(*) AS num_series_test, {', '.join(f'round(avg({c}), 5) AS mean_{c}' for c in METRICS)}, round(avg(wb.wd), 5) AS mean_WD_BI,
           round(avg(wi.wd), 5) AS mean_WD_IBG, round(avg(NZ_SCALED_BI), 5) AS mean_MAPE, round(median(NZ_SCALED_BI), 5) AS median_NZ_SCALED,
           round(median(NZ_SCALED_BI), 5) AS median_MAPE, round(median(wb.wd), 5) AS median_WD
    FROM per JOIN wb USING (user_id) JOIN wi USING (user_id)""",
)
def forecast_report(spark, sf):
    cases = P.predict_last(_cases(spark, sf))
    per = P.burst_metrics(cases, ["user_id"], scale=1e3).join(P.merged_metrics(cases, ["user_id"], scale=1e3), "user_id")
    rep = P.metric_report(per)
    keep = [f"mean_{c}" for c in METRICS] + [
        "mean_WD_BI", "mean_WD_IBG", "mean_MAPE", "median_NZ_SCALED", "median_MAPE", "median_WD",
    ]
    return rounded(rep.select("num_series_test", *keep), 5)


@query("forecast_report_full")
def forecast_report_full(spark, sf):
    """All report figures for the resampling predictor."""
    cases = P.predict_resampled(_cases(spark, sf), ["user_id"])
    stored = cut_lineage(cases, "forecasts")
    per = P.burst_metrics(stored, ["user_id"]).join(P.merged_metrics(stored, ["user_id"]), "user_id")
    return P.metric_report(per)


@query(
    "predict_median",
    f"""WITH {FORECAST}, o AS (SELECT user_id, bi, row_number() OVER (PARTITION BY user_id ORDER BY bi) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM parts WHERE k < 0),
    m AS (SELECT user_id, bi AS v FROM o WHERE k = (n - 1) // 2 + 1), h AS (SELECT user_id, CAST(count(*) AS INTEGER) AS horizon FROM cmp GROUP BY ALL)
    SELECT user_id, v AS predicted, horizon FROM m JOIN h USING (user_id)""",
)
def predict_median(spark, sf):
    got = P.predict_median(_cases(spark, sf))
    return got.select("user_id", F.get("pred_bi", F.lit(0)).alias("predicted"), F.size("pred_bi").alias("horizon"))


def _tok_sql(v, edges):
    return f"len(list_filter({edges}::DOUBLE[], lambda e: e < {v}))"


BI_EDGES, IBG_EDGES = [2000.0, 4000.0, 6000.0, 9000.0], [2.0, 5.0, 10.0, 20.0]


@query(
    "token_accuracy",
    f"""WITH {FORECAST}, t AS (SELECT k, gb > 0 AS okb, gi > 0 AS oki, {_tok_sql('gb', BI_EDGES)} = {_tok_sql('fb', BI_EDGES)} AND fb > 0 AS hb,
      {_tok_sql('gi', IBG_EDGES)} = {_tok_sql('fi', IBG_EDGES)} AND fi > 0 AS hi FROM cmp WHERE k >= 1),
    s AS (SELECT count(*) FILTER (WHERE okb AND hb) AS a, count(*) FILTER (WHERE okb) AS b, count(*) FILTER (WHERE oki AND hi) AS c, count(*) FILTER (WHERE oki) AS d FROM t)
    SELECT round(a / b, 8) AS accuracy_bi, round(c / d, 8) AS accuracy_ibg, round((a + c) / (b + d), 8) AS accuracy, b + d AS n_positions FROM s""",
)
def token_accuracy(spark, sf):
    cases = P.predict_last(_cases(spark, sf))
    toks = {}
    for s, edges in (("bi", BI_EDGES), ("ibg", IBG_EDGES)):
        for side in ("pred", "gt"):
            toks[f"{side}_tok_{s}"] = T.encode_global(F.col(f"{side}_{s}"), edges, n_special=3, n_tokens=64)
    return rounded(P.token_accuracy(cases.withColumns(toks), skip=1), 8)


# ---- hooks --------------------------------------------------------------------------------


@query("embed_series")
def embed_series(spark, sf):
    """Series to vectors through the batch hook, with the spectrum as stand-in model."""
    import numpy as np

    def spectrum(frame):
        rows = np.stack([np.asarray(x, dtype=float) for x in frame["s"]])
        return np.abs(np.fft.rfft(rows, axis=1))[:, :8]

    s = src.series(spark, sf).select("user_id", X.fixed_length(F.col("inbound"), 744).alias("s"))
    return rounded(P.embed_batches(s, ["user_id"], spectrum, 8), 4)


@query(
    "step_embeddings",
    f"""WITH {src.BURSTS}, w AS (SELECT user_id, pos, bi, sum(bi) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS s FROM bursts)
    SELECT user_id, CAST(pos AS INTEGER) AS time_step, s::DOUBLE AS total, bi::DOUBLE AS target FROM w WHERE pos >= 8""",
)
def step_embeddings(spark, sf):
    got = P.step_embeddings(src.bursts(spark, sf), ["user_id"], "bi", 8)
    return got.select(
        "user_id", "time_step", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"), "target"
    )


@query("probe_multiclass")
def probe_multiclass(spark, sf):
    return P.probe_on_vectors(src.vectors(spark, sf), "vector", "cluster_id", "multiclass", keys=["vec_id"], max_iter=30)


@query("probe_regression")
def probe_regression(spark, sf):
    both = src.vectors(spark, sf).join(src.user_features(spark, sf).select("vec_id", "value__mean"), "vec_id")
    return P.probe_on_vectors(both, "vector", "value__mean", "regression", keys=["vec_id"], max_iter=30)


@query("probe_perceptron")
def probe_perceptron(spark, sf):
    return P.probe_on_vectors(
        src.vectors(spark, sf), "vector", "cluster_id", "multiclass", keys=["vec_id"], hidden=[16], max_iter=20
    )


# ---- streams ------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = src.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


@query(
    "stream_tumbling_sums",
    f"""WITH {src.EVENTS}, w AS (SELECT user_id, second // 86400 AS d, CAST(sum(cents) AS BIGINT) AS sum_value, count(*) AS n FROM ev GROUP BY ALL)
    SELECT user_id, make_timestamp(d * 86400000000) AS window_start, sum_value, n FROM w""",
)
def stream_tumbling_sums(spark, sf):
    """Windows as the stream closes them, and those open at its end from its state."""
    got = ST.all_tumbling_sums(event_stream(spark, sf), ["user_id"], "ts", "cents", "1 day", "1 hour")
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_gap_sessions",
    f"""WITH {SESSIONS}, s AS (SELECT user_id, session_id, min(second) AS a, max(second) AS b, count(*) AS n_events, CAST(sum(cents) AS BIGINT) AS sum_value FROM sess GROUP BY ALL)
    SELECT user_id, make_timestamp(a * 1000000) AS session_start, make_timestamp(b * 1000000) AS session_last, n_events, sum_value FROM s""",
)
def stream_gap_sessions(spark, sf):
    got = ST.all_gap_sessions(event_stream(spark, sf), ["user_id"], "ts", "cents", 43_200, "1 hour")
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_last")})


@query(
    "stream_bursts",
    f"""WITH {src.EVENTS}, h AS (SELECT user_id, second // 3600 AS bin, CAST(sum(cents) AS BIGINT) AS v FROM ev GROUP BY ALL)
    SELECT user_id, bin, v::DOUBLE AS bi, coalesce(bin - lag(bin) OVER (PARTITION BY user_id ORDER BY bin), 0) AS ibg
    FROM h WHERE v >= 1000""",
)
def stream_bursts(spark, sf):
    return ST.all_bursts(event_stream(spark, sf), ["user_id"], "ts", "cents", 3_600, 1000.0, "1 hour")
