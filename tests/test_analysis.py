import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstseries.operators import clusters as C
from burstseries.operators import explain as E
from burstseries.operators import features as X
from burstseries.operators import gram as G
from burstseries.operators import sweep as W


def test_minimal_features(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 4.0]), ("b", [])], "k string, s array<double>")
    rows = {r["k"]: r for r in X.minimal_features(df, ["k"], "s").collect()}
    a = rows["a"]
    assert a["value__sum_values"] == 7 and a["value__median"] == 2 and a["value__length"] == 3
    assert a["value__variance"] == pytest.approx(np.var([1, 2, 4]))
    assert a["value__root_mean_square"] == pytest.approx(math.sqrt(7))
    assert rows["b"]["value__mean"] is None and rows["b"]["value__length"] == 0


def test_extended_features_by_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(1.0, 4.0, 80) * (rng.random(80) < 0.6), 2)
    df = spark.createDataFrame([("a", x.tolist())], "k string, s array<double>")
    got = {k.removeprefix("value__"): v for k, v in X.extended_features(df, ["k"], "s").first().asDict().items()}
    m, sd, d, n = x.mean(), x.std(), np.diff(x), len(x)
    want = {
        "abs_energy": (x * x).sum(),
        "mean_abs_change": np.abs(d).mean(),
        "mean_change": (x[-1] - x[0]) / (n - 1),
        "cid_ce__normalize_True": math.sqrt((d * d).sum()) / sd,
        "count_above_mean": (x > m).sum(),
        "last_location_of_minimum": 1 - x[::-1].argmin() / n,
        "first_location_of_maximum": x.argmax() / n,
        "autocorrelation__lag_2": ((x[:-2] - m) * (x[2:] - m)).sum() / (n - 2) / sd**2,
        "c3__lag_2": (x[4:] * x[2:-2] * x[:-4]).mean(),
        "time_reversal_asymmetry_statistic__lag_1": (x[2:] ** 2 * x[1:-1] - x[1:-1] * x[:-2] ** 2).mean(),
        "ratio_beyond_r_sigma__r_1": (np.abs(x - m) > sd).mean(),
        "quantile__q_0_1": np.quantile(x, 0.1),
        "linear_trend__attr_slope": np.polyfit(np.arange(n), x, 1)[0],
        "share_of_zeros": (x == 0).mean(),
        "mean_second_derivative_central": (x[-1] - x[-2] - x[1] + x[0]) / 2 / (n - 2),
        "has_duplicate_min": float((x == x.min()).sum() >= 2),
    }
    k = 3
    want["number_peaks__n_3"] = sum(
        all(x[i] > x[i - j] and x[i] > x[i + j] for j in range(1, k + 1)) for i in range(k, n - k)
    )
    best = run = 0
    for up in x < m:
        run = run + 1 if up else 0
        best = max(best, run)
    want["longest_strike_below_mean"] = best
    h = np.histogram(x, bins=10)[0] / n
    want["binned_entropy__max_bins_10"] = -(h[h > 0] * np.log(h[h > 0])).sum()
    for name, value in want.items():
        assert got[name] == pytest.approx(float(value), abs=1e-9), name


def test_flat_and_tiny_series(spark):
    df = spark.createDataFrame([("flat", [2.0] * 5), ("one", [3.0]), ("none", [])], "k string, s array<double>")
    rows = {r["k"]: r.asDict() for r in X.extended_features(df, ["k"], "s").collect()}
    assert rows["flat"]["value__skewness"] is None and rows["flat"]["value__binned_entropy__max_bins_10"] == 0
    assert rows["one"]["value__mean_abs_change"] is None and rows["one"]["value__number_peaks__n_1"] == 0
    assert rows["none"]["value__abs_energy"] == 0


def test_spectral_features(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(200)
    for i in range(2, 200):
        x[i] = 0.5 * x[i - 1] - 0.3 * x[i - 2] + rng.normal()
    df = spark.createDataFrame([("a", x.tolist()), ("short", [1.0]), ("none", None)], "k string, s array<double>")
    rows = {r["k"]: r.asDict() for r in X.spectral_features(df, ["k"], "s").collect()}
    assert rows["a"]["value__fft_coefficient__attr_abs__coeff_1"] == pytest.approx(abs(np.fft.rfft(x)[1]))
    assert rows["a"]["value__ar_coefficient__coeff_1__k_2"] == pytest.approx(0.5, abs=0.2)
    assert rows["short"]["value__ar_coefficient__coeff_0__k_2"] is None
    assert rows["none"]["value__fft_coefficient__attr_abs__coeff_0"] is None


def test_padding_and_fano(spark):
    df = spark.createDataFrame([([1.0, -2.0, None, 4.0],), (None,)], "s array<double>")
    got = [r[0] for r in df.select(X.fixed_length(F.col("s"), 6)).collect()]
    assert got == [[1.0, 0.0, 0.0, 4.0, 0.0, 0.0], [0.0] * 6]
    f = spark.createDataFrame([([1.0, 3.0, float("nan")],), ([5.0],), ([0.0, 0.0],)], "s array<double>")
    assert [r[0] for r in f.select(X.fano(F.col("s"))).collect()] == [0.5, None, None]
    assert f.select(X.fano(F.col("s"), sample=True)).first()[0] == 1.0


def test_cleaning(spark):
    rows = [(i, str(float(i)), "x" if i < 5 else "1.5", float("inf") if i == 3 else 0.0, 7.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c double, d double")
    assert X.usable_columns(df, ["a", "b", "c", "d"]) == ["a"]
    strict = X.clean_strict(df, ["id"], ["a", "b", "c", "d"])
    assert strict.columns == ["id", "a"] and strict.count() == 19
    assert X.clean_minimal(df, ["b", "c"]).filter("b = 0").count() == 5
    with pytest.raises(ValueError):
        X.clean_strict(df, ["id"], ["d"])
    assert X.feature_columns(df) == ["id", "c", "d"]


def test_impute_is_global(spark):
    rows = [("f", 1.0), ("f", 5.0), ("f", None), ("f", float("inf")), ("f", float("-inf")), ("f", float("nan")), ("g", None)]
    df = spark.createDataFrame(rows, "feature string, value double")
    got = sorted((r["feature"], r["value"]) for r in X.impute_long(df.repartition(5)).collect())
    assert got == [("f", 1.0), ("f", 1.0), ("f", 3.0), ("f", 3.0), ("f", 5.0), ("f", 5.0), ("g", 0.0)]


LONG = "cluster_id int, row int, feature string, value double"


def _long(spark, data):
    return spark.createDataFrame([(c, i, "f", v) for c, vs in data.items() for i, v in enumerate(vs)], LONG)


def test_effect_of_equal_means_is_zero(spark):
    s = E.cluster_stats(_long(spark, {0: [1.0, 3.0], 1: [2.0] * 8}))
    got = {r["cluster_id"]: r["cohens_d"] for r in E.cohens_d(s).collect()}
    assert got == {0: 0.0, 1: 0.0}


def test_effect_floor(spark):
    s = E.cluster_stats(_long(spark, {0: [5.0, 5.0], 1: [2.0, 2.0, 2.0]}))
    got = {r["cluster_id"]: r["cohens_d"] for r in E.cohens_d(s).collect()}
    assert got[0] == pytest.approx(3 / (1e-3 * 3)) and got[1] == pytest.approx(-3 / (1e-3 * 6))


def test_singletons(spark):
    long = _long(spark, {0: [1.0], 1: [2.0, 4.0], 2: [None, 6.0]})
    s = E.cluster_stats(long)
    assert {r["cluster_id"]: r["var"] for r in s.collect()} == {0: None, 1: 1.0, 2: None}
    fisher = E.global_fisher(s).first()
    assert fisher["n_groups_with_var"] == 3 and fisher["within_var_mean"] == pytest.approx(1 / 3)
    inv = E.invariance_scores(s, min_cluster_size=1).first()
    assert inv["within_var_mean"] == 1.0 and inv["clusters_used"] == 3
    assert inv["total_var"] == pytest.approx(np.var([1, 2, 4, 6]))
    assert E.invariance_scores(s, min_cluster_size=3).count() == 0


def test_rank_ties_and_nulls(spark):
    rows = [(0, f, v) for f, v in (("a", 1.0), ("b", 1.0), ("c", 0.5), ("d", None), ("e", None))]
    df = spark.createDataFrame(rows, "cluster_id int, feature string, var double")
    got = {r["feature"]: r["variance_rank"] for r in E.variance_rank(df).collect()}
    assert got == {"c": 1.0, "a": 2.5, "b": 2.5, "d": 4.5, "e": 4.5}
    s = df.withColumns({"n_members": F.lit(3), "mean": F.lit(0.0)})
    out = E.rank_export(s).first()
    assert json.loads(out["features"])["a"]["rank"] == 2


def test_filters(spark):
    m = spark.createDataFrame(
        [("a", 0.5, 0.1), ("b", 0.05, 0.9), ("c", 0.3, 0.8), ("d", None, 0.95)],
        "feature string, fisher_ratio double, cka_to_embedding double",
    )
    order = lambda df: [r["feature"] for r in df.orderBy("rank").collect()]
    assert order(E.filter_features(m, "intersection", top_k=3, at_least=0.1)) == ["c"]
    assert order(E.filter_features(m, "fisher_min", at_least=0.1)) == ["a", "c"]
    given = spark.createDataFrame([(0, "c"), (1, "zz"), (2, "a"), (3, "c")], "pos int, feature string")
    assert order(E.filter_features(m, "precomputed", precomputed=given)) == ["c", "a"]
    with pytest.raises(ValueError):
        E.require_rows(m.filter("false"), "nothing")


def test_similarity_identities(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) + 1e6
    y = np.column_stack([3 * x[:, 0] + 5, rng.normal(size=40), np.full(40, 4.0)])
    rows = [(int(i % 2), *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "g int, x0 double, x1 double, x2 double, y0 double, y1 double, y2 double")
    xs = ["x0", "x1", "x2"]
    same = G.block_similarity(df.withColumns({f"z{i}": F.col(f"x{i}") * 3 for i in range(3)}), xs, ["z0", "z1", "z2"]).first()
    assert same["cka"] == pytest.approx(1.0) and same["n_samples"] == 40
    assert G.block_similarity(df, xs, ["y2"]).first()["cka"] is None
    got = {r["feature"]: r for r in G.feature_similarity(df, xs, ["y0", "y1", "y2"]).collect()}
    assert got["y2"]["cka_to_embedding"] == 0.0 and got["y2"]["is_constant"]

    def cka(a, b):
        a, b = a - a.mean(0), b - b.mean(0)
        return np.linalg.norm(a.T @ b) ** 2 / (np.linalg.norm(a.T @ a) * np.linalg.norm(b.T @ b))

    for i in (0, 1):
        assert got[f"y{i}"]["cka_to_embedding"] == pytest.approx(cka(x, y[:, [i]]), rel=1e-6)
    per = {(r["g"], r["feature"]): r["cka_to_embedding"] for r in G.feature_similarity(df, xs, ["y1"], ["g"], min_rows=2).collect()}
    for g in (0, 1):
        assert per[g, "y1"] == pytest.approx(cka(x[g::2], y[g::2, 1:2]), rel=1e-6)


def test_rows_with_gaps_are_dropped_first(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 99.0)], "x double, y double")
    got = G.block_similarity(df, ["x"], ["y"]).first()
    assert (got["n_merged"], got["n_samples"]) == (4, 3) and got["cka"] == pytest.approx(1.0)


def test_geometry(spark):
    v = "k int, g int, v array<double>"
    same = G.direction_stats(spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0])], v), [], "v").first()
    assert same["mean_pairwise_cosine"] == 1.0 and same["dominant_dim"] == 0
    rows = [(0, 0, [0.0, 1.0]), (1, 0, [0.0, -1.0]), (2, 1, [3.0, 4.0]), (3, 0, [float("nan"), 1.0])]
    got = {r["g"]: r for r in G.direction_stats(spark.createDataFrame(rows, v), ["g"], "v").collect()}
    assert got[0]["mean_pairwise_cosine"] == -1.0 and got[0]["dominant_dim"] == 1
    assert got[1]["mean_pairwise_cosine"] is None and got[1]["dominant_dim"] == -1
    rng = np.random.default_rng(4)
    m = rng.normal(size=(30, 4)) * [5, 1, 1, 0.1]
    df = spark.createDataFrame([(i, 0, list(map(float, r))) for i, r in enumerate(m)], v)
    lam = np.linalg.svd(m - m.mean(0), compute_uv=False) ** 2
    p = lam / lam.sum()
    spec = G.spectrum_stats(df, [], "v").first()
    assert spec["top_variance_ratio"] == pytest.approx(p[0])
    assert spec["effective_rank_norm"] == pytest.approx(np.exp(-(p * np.log(p)).sum()) / 4)
    score = (m - m.mean(0)) @ np.linalg.svd(m - m.mean(0))[2][0]
    feats = df.withColumns({"f": F.get("v", F.lit(0)) * 2 + F.get("v", F.lit(1)), "c": F.lit(1.0)})
    al = {r["feature"]: r["abs_corr"] for r in G.component_alignment(feats, "v", ["f", "c"], ["k"]).collect()}
    assert al["f"] == pytest.approx(abs(np.corrcoef(score, 2 * m[:, 0] + m[:, 1])[0, 1])) and al["c"] is None


def brute_density(points, eps, least):
    d = np.linalg.norm(points[:, None] - points[None], axis=2) <= eps
    core = d.sum(1) >= least
    label = np.full(len(points), -1)
    nxt = 0
    for i in range(len(points)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] >= 0:
                continue
            label[j] = nxt
            if core[j]:
                todo += [k for k in np.flatnonzero(d[j]) if label[k] < 0 and core[k]]
        nxt += 1
    return core, label


def test_density_clusters_with_copies_and_blocks(spark):
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (40, 2)), rng.uniform(-10, 15, (15, 2)), np.zeros((30, 2))])
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(pts)], "id_ int, v array<double>")
    got = {r["id_"]: r["label"] for r in C.density_labels(df, ["id_"], "v", eps=0.5, min_samples=5, block_rows=10).collect()}
    core, want = brute_density(pts, 0.5, 5)
    mine = np.array([got[i] for i in range(len(pts))])
    pairs = {(a, b) for a, b in zip(want[core], mine[core], strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    near_core = (np.linalg.norm(pts[:, None] - pts[None], axis=2) <= 0.5)[:, core].any(1)
    assert ((mine == -1) == ~near_core).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i != 30], "id string, to string")
    got = {r["id"]: r["component"] for r in C.connected_components(edges).collect()}
    assert {got[f"{i:03d}"] for i in range(31)} == {"000"}
    assert {got[f"{i:03d}"] for i in range(31, 61)} == {"031"}


def test_kmeans_bounds_and_sweep(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5), 1.0]) for i in range(15)], "id_ int, v array<double>")
    got = C.kmeans_labels(df, ["id_"], "v", 3, n_init=2).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["label"], set()).add(r["id_"] // 5)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
    for k in (1, 15):
        with pytest.raises(ValueError):
            C.kmeans_labels(df, ["id_"], "v", k)
    swept = C.sweep_labels(df, ["id_"], "v", [2, 3], [1], str(tmp_path / "sweep"))
    assert {(r["k"], r["seed"]): r["count"] for r in swept.groupBy("k", "seed").count().collect()} == {(2, 1): 15, (3, 1): 15}


def test_best_run_ties(spark):
    rows = [(4, 1, 1, "2.0"), (4, 2, 1, "2.0"), (4, 3, 1, "x"), (5, 1, 2, "1.0"), (5, 1, 2, "3.0"), (5, 2, 2, "1.5")]
    means = W.run_means(spark.createDataFrame(rows, "k int, run int, seed int, fisher_ratio string"))
    got = {r["k"]: r for r in W.best_runs(means).collect()}
    assert got[4]["best_run"] is None and got[4]["best_runs_tied"] == "run1_seed1,run2_seed1"
    assert (got[5]["best_run"], got[5]["best_mean_fisher"], got[5]["n_configs_with_scores"]) == (1, 2.0, 2)


def test_quality_scores_say_why_not(spark):
    long = spark.createDataFrame([(0, i, "f", float(i)) for i in range(4)] + [(1, 9, "f", 3.0)], LONG)
    got = C.quality_scores(long, ["row"], min_cluster_size=2).first()
    assert got["calinski_harabasz"] is None and got["status"].startswith("need_at_least_two")


def test_similarity_drops_rows_per_feature(spark):
    """A half-empty or empty feature beside it changes nothing for a whole one."""
    from burstseries.operators.gram import feature_similarity

    rows = [(float(i), float(i * i % 7), float(i % 5), float(i % 3) if i % 2 else None, None) for i in range(20)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, a double, b double, c double")
    alone = feature_similarity(df, ["x1", "x2"], ["a"]).first()
    got = {r["feature"]: r for r in feature_similarity(df, ["x1", "x2"], ["a", "b", "c"]).collect()}
    assert set(got) == {"a", "b"} and got["a"]["n"] == 20 and got["b"]["n"] == 10
    assert abs(got["a"]["cka_to_embedding"] - alone["cka_to_embedding"]) < 1e-12
    half = feature_similarity(df.filter("b is not null"), ["x1", "x2"], ["b"]).first()
    assert abs(got["b"]["cka_to_embedding"] - half["cka_to_embedding"]) < 1e-12


def test_near_rows_take_room_for_a_stripe_only():
    """Neighbours within eps in a block pair of 4,000 rows, without a table of all pairs."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.random((4000, 2))
    tracemalloc.start()
    near = C._Near(pd.Series(list(x)), 0.1)
    counts = np.concatenate([near(rows).sum(1) for rows in near.stripes(np.arange(len(x)))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # 16 million distances would take 128 MB
    some = rng.integers(0, 4000, 20)
    assert [(np.hypot(*(x - x[i]).T) <= 0.1).sum() for i in some] == counts[some].tolist()
