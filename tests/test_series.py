import numpy as np
import pytest
from pyspark.sql import functions as F

from burstseries.operators import bursts as B
from burstseries.operators import dense as D
from burstseries.operators import quantiles as Q
from burstseries.operators import splits as S
from burstseries.operators import tokens as T


def one(spark, values, kind="array<double>"):
    return spark.createDataFrame([("k", values)], f"k string, inbound {kind}")


def test_burst_positions(spark):
    got = B.bursts_from_series(one(spark, [0.0, 120.0, 0.0, 0.0, 300.0, 100.0, 99.0]), ["k"], threshold=100, min_len=1, keep_bins=True).first()
    assert (got["active_bins"], got["bi"], got["ibg"], got["first_bin"]) == ([1, 4, 5], [120, 300, 100], [0, 3, 1], 1)


@pytest.mark.parametrize("values", [[], None])
def test_empty_series_give_no_row(spark, values):
    assert B.bursts_from_series(one(spark, values), ["k"], threshold=1, min_len=0).count() == 0


def test_threshold_zero_takes_all_bins(spark):
    got = B.bursts_from_series(one(spark, [0.0, 5.0]), ["k"], threshold=0, min_len=1).first()
    assert got["bi"] == [0, 5] and got["ibg"] == [0, 1]


def test_units_and_cut(spark):
    got = B.bursts_from_series(one(spark, [5.0, 0.0, 5.9, 7.0]), ["k"], threshold=5, min_len=2, max_len=2, unit=1000).first()
    assert got["bi"] == [5, 5] and got["ibg"] == [0, 2000]


@pytest.mark.parametrize(("mode", "length"), [("span", 10), ("kept", 2)])
def test_dense_cut(spark, mode, length):
    bins = spark.createDataFrame([("a", 100, 5), ("a", 109, 7)], "k string, bin long, v long")
    got = D.dense_series(bins, ["k"], {"x": "v"}, threshold=1, max_len=100, min_len=1, truncate=mode).first()
    assert len(got["x"]) == length and got["x"][0] == 5.0 and got["first_bin"] == 100


def test_dense_span_clamp_keeps_trailing_zeros(spark):
    bins = spark.createDataFrame([("a", 0, 5), ("a", 2, 0), ("a", 50, 9)], "k string, bin long, v long")
    got = D.dense_series(bins, ["k"], {"x": "v"}, threshold=1, max_len=6, min_len=1).first()
    assert got["x"] == [5.0, 0, 0, 0, 0, 0]


def test_dense_drops_short_and_null(spark):
    bins = spark.createDataFrame([("a", 0, 5), ("a", None, 5), ("b", 0, 1), ("b", 1, 9), ("b", 3, 9)], "k string, bin long, v long")
    got = D.dense_series(bins, ["k"], {"x": "v"}, threshold=2, max_len=9, min_len=2).collect()
    assert [(r["k"], r["x"]) for r in got] == [("b", [0.0, 9.0, 0.0, 9.0])]
    both = D.one_direction(D.dense_series(bins, ["k"], {"inbound": "v"}, threshold=2, max_len=9, min_len=2), copy=True).first()
    assert both["outbound"] == both["inbound"]


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i % 5}", int(b), int(v)) for i, (b, v) in enumerate(zip(rng.integers(0, 80, 200), rng.integers(0, 9, 200), strict=True))]
    df = spark.createDataFrame(rows, "k string, bin long, v long").groupBy("k", "bin").agg(F.sum("v").alias("v"))
    got = {r["k"]: r["x"] for r in D.dense_series(df, ["k"], {"x": "v"}, threshold=4, max_len=40, min_len=1).collect()}
    sums: dict = {}
    for k, b, v in rows:
        sums.setdefault(k, {}).setdefault(b, 0)
        sums[k][b] += v
    for k, bins in sums.items():
        lo = min(bins)
        hi = min(max(bins), lo + 39)
        assert got[k] == [float(bins.get(b, 0)) if bins.get(b, 0) >= 4 else 0.0 for b in range(lo, hi + 1)]


def test_calendar(spark):
    bins = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), (None, 7, 1)], "k string, bin long, v long")
    got = sorted((r["k"] or "", r["bin"], r["v"]) for r in D.dense_calendar(bins, ["k"], ["v"]).collect())
    assert got == [("", 7, 1), ("a", 1, 5), ("a", 2, 0), ("a", 3, 6)]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_long_bursts_do_not_depend_on_chunks(spark, chunk):
    bins = spark.createDataFrame([("a", b, b % 4) for b in range(30)], "k string, bin long, v long")
    got = B.burst_rows(bins, ["k"], "v", threshold=2, chunk_bins=chunk).orderBy("bin").collect()
    want = [b for b in range(30) if b % 4 >= 2]
    assert [r["bin"] for r in got] == want
    assert [r["pos"] for r in got] == list(range(len(want)))
    assert [r["ibg"] for r in got] == [0, *np.diff(want).tolist()]


def test_chunked_bursts_restart_gaps(spark):
    bins = spark.createDataFrame([("a", 3 * b, 9.0) for b in range(7)], "k string, bin long, v double")
    got = B.burst_chunks(B.burst_rows(bins, ["k"], "v", threshold=1), ["k"], 3).orderBy("chunk_idx").collect()
    assert [(r["first_bin"], r["ibg"]) for r in got] == [(0, [0, 3, 3]), (9, [0, 3, 3])]
    again = B.rebuild_bins(B.burst_chunks(B.burst_rows(bins, ["k"], "v", threshold=1), ["k"], 3), ["k", "chunk_idx"])
    assert sorted(r["bin"] for r in again.collect()) == [0, 3, 6, 9, 12, 15]


def test_chunk_bins(spark):
    chunks = spark.createDataFrame([("a", 0, 40, [0.0, 7.5, 0.0, 8.0])], "k string, chunk_idx int, first_bin long, inbound array<double>")
    got = B.bursts_from_chunks(chunks, ["k", "chunk_idx"], threshold=1, min_len=1, keep_bins=True).first()
    assert (got["active_bins"], got["bi"], got["ibg"], got["example_id"]) == ([41, 43], [7.5, 8.0], [0, 2], "a_0")
    plain = B.bursts_from_chunks(chunks.drop("first_bin"), ["k", "chunk_idx"], threshold=1, min_len=1).first()
    assert plain["first_bin"] == 1


def test_rebuild_and_expand(spark):
    df = spark.createDataFrame([("a", 1, [5, 6, 7], [0, 3, 1])], "k string, first_bin long, bi array<long>, ibg array<long>")
    assert sorted(r["bin"] for r in B.rebuild_bins(df, ["k"]).collect()) == [1, 4, 5]
    t = spark.createDataFrame([([7.0, 9.0], [0.0, 3.0])], "bi array<double>, ibg array<double>")
    assert t.select(B.expand_timeline(F.col("ibg"), F.col("bi"))).first()[0] == [7.0, 0.0, 0.0, 9.0]
    odd = spark.createDataFrame([([1.0, 2.0, 3.0], [float("nan"), float("inf"), 3.7])], "bi array<double>, ibg array<double>")
    assert odd.select(B.expand_timeline(F.col("ibg"), F.col("bi"))).first()[0] == [1.0, 2.0, 0.0, 0.0, 3.0]
    k = [t.select(B.bursts_covering(F.col("ibg"), F.lit(n))).first()[0] for n in (0, 1, 2, 4, 99)]
    assert k == [0, 1, 2, 2, 2]


def test_expansion_gives_the_series_back(spark):
    rng = np.random.default_rng(3)
    values = [float(v) if v > 5 else 0.0 for v in rng.integers(0, 10, 60)]
    b = B.bursts_from_series(one(spark, values), ["k"], threshold=1, min_len=1)
    got = b.select(B.expand_timeline(F.col("ibg"), F.col("bi")), "first_bin").first()
    start = got[1]
    last = max(i for i, v in enumerate(values) if v)
    assert got[0] == values[start : last + 1]


@pytest.mark.parametrize(("n", "ctx"), [(90, 62), (1, 0), (10, 7), (3, 2)])
def test_geometry(spark, n, ctx):
    df = spark.createDataFrame([("a", 4, [9] * n, [0] + [2] * (n - 1))], "k string, first_bin long, bi array<long>, ibg array<long>")
    got = S.context_forecast(S.length_filter(df, min_bursts=1), 0.7).first()
    assert (got["context_len"], got["forecast_len"]) == (ctx, n - ctx)
    assert got["context_end_bin"] == (None if ctx == 0 else 4 + 2 * (ctx - 1))
    assert got["forecast_start_bin"] == 4 + 2 * ctx and got["forecast_end_bin"] == 4 + 2 * (n - 1)
    binned = df.withColumn("active_bins", F.sequence(F.lit(4).cast("long"), F.lit(4 + 2 * (n - 1)).cast("long"), F.lit(2).cast("long")))
    same = S.context_forecast(S.length_filter(binned, min_bursts=1), 0.7).first()
    assert [same[c] for c in S.META[5:8]] == [got[c] for c in S.META[5:8]]


def test_mirror_by_time_and_parity(spark):
    series = one(spark, [0.0, 120.0, 0.0, 0.0, 300.0, 100.0, 99.0])
    meta = spark.createDataFrame(
        [("k", "test", 2, 1, 5, 5)], "k string, split string, context_len int, forecast_len int, forecast_start_bin long, forecast_end_bin long"
    )
    got = S.mirror_series(series, meta, ["k"], threshold=100)
    row = got.first()
    assert row["context_inbound"] == [0.0, 120.0, 0.0, 0.0, 300.0] and row["forecast_inbound"] == [100.0]
    assert tuple(S.burst_parity(got, strict=True).first()) == (0, 1)
    legacy = S.mirror_series(series, meta, ["k"], mode="legacy_index").first()
    assert legacy["context_inbound"] == [0.0, 120.0] and legacy["forecast_inbound"] == [0.0]
    off = S.mirror_series(series, meta.withColumn("forecast_len", F.lit(3)), ["k"], threshold=100)
    with pytest.raises(Exception, match="burst counts differ"):
        S.burst_parity(off, strict=True).collect()


def test_mirror_without_forecast(spark):
    meta = spark.createDataFrame(
        [("k", "test", 3, 0, 2, None)], "k string, split string, context_len int, forecast_len int, forecast_start_bin long, forecast_end_bin long"
    )
    row = S.mirror_series(one(spark, [1.0, 2.0, 3.0]), meta, ["k"], threshold=1).first()
    assert row["forecast_inbound"] == [] and row["sparse_forecast_len"] == 0


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = S.assign_split(df.repartition(3), ["k"], 0.7).orderBy("k").collect()
    b = S.assign_split(df.repartition(7), ["k"], 0.7).orderBy("k").collect()
    assert a == b
    assert 0.6 < sum(r["split"] == "train" for r in a) / 500 < 0.8
    cut = S.shuffle_cut(df, ["k"], 0.25).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in cut} == {"train": 125, "val": 375}


def test_windows_and_horizons(spark):
    df = spark.createDataFrame([("a", list(range(10))), ("b", [1, 2])], "k string, bi array<long>")
    got = sorted((r["k"], r["bi"]) for r in S.training_windows(df, ["bi"], 4, 3).collect())
    assert got == [("a", [0, 1, 2, 3]), ("a", [4, 5, 6, 7]), ("b", [1, 2])]
    lens = spark.createDataFrame([(n,) for n in (104, 105, 200, 101)], "n int")
    c, h = S.horizon_split(F.col("n"), min_ctx=100, min_h=5)
    assert [tuple(r) for r in lens.select(c, h).collect()] == [(None, None), (100, 5), (140, 60), (None, None)]
    c, h = S.horizon_split(F.col("n"), min_ctx=100, min_h=5, longest=True)
    assert [tuple(r) for r in lens.select(c, h).collect()][2] == (195, 5)


def test_loaders(spark):
    df = spark.createDataFrame([("a", [1.0, -1.0, 0.0, 2.0, 3.0]), ("b", [-1.0, 0.0])], "k string, x array<double>")
    assert [(r["k"], r["x"]) for r in S.positive_only(df, ["x"], 2, 2).collect()] == [("a", [1.0, 2.0])]
    b = spark.createDataFrame(
        [("a", [1, 2], [0, 1]), ("b", None, None), ("c", [1, 2], [0])], "k string, bi array<long>, ibg array<long>"
    )
    assert [r["k"] for r in S.burst_loader(b, 1).collect()] == ["a"]
    n = spark.createDataFrame([("a", [[0.0, 5.0, -1.0, 0.0, 6.0], [1.0, 7.0], [0.0]])], "k string, f array<array<double>>")
    assert [r["series"] for r in S.nested_loader(n, ["k"], "f", 1).collect()] == [[5.0, 6.0]]


def test_threshold_interpolation(spark):
    df = spark.createDataFrame([([0.1, 0.5, 1.0], [0.0, 10.0, 20.0])], "l array<double>, q array<double>")
    got = [df.select(Q.interpolate(F.col("l"), F.col("q"), x)).first()[0] for x in (0.3, 0.05, 1.0, 0.5)]
    assert got == pytest.approx([5.0, 0.0, 20.0, 10.0])


def reference_edges(data, n_bins):
    """Straight numpy reading of the edge rule, for comparison on small data."""
    flat = np.sort(np.asarray(data, dtype=float))
    edges, rest, left = [], flat, n_bins
    while left > 1 and len(rest):
        cuts = np.percentile(rest, np.arange(1, left) * (100.0 / left), method="lower")
        dup = next((b for a, b in zip(cuts, cuts[1:], strict=False) if a == b), None)
        if dup is None:
            return [*edges, *cuts, flat[-1]]
        edges += [c for c in cuts if c < dup] + [dup]
        left = n_bins - len(edges)
        rest = rest[rest > dup]
    return [*edges, flat[-1]]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_quantile_edges(spark, seed):
    rng = np.random.default_rng(seed)
    data = np.concatenate([np.full(300, 2.0), rng.integers(1, 60, 400), rng.integers(100, 5000, 200)]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    got = Q.quantile_edges(df, "v", 12)
    want = reference_edges(data, 12)
    assert got[: len(want)] == want or set(want) <= set(got)
    assert got == sorted(got) and got[-1] == data.max()
    assert Q.token_boundaries(df, "v", 12)[0] == data.min() * 0.8
    assert Q.token_boundaries(df.filter("v < 0"), "v", 12) == [0.0, 1e6]


def test_running_counts(spark):
    df = spark.createDataFrame([(float(i % 97),) for i in range(1000)], "v double")
    got = Q.cumulative_counts(df, "v", ranges=8).orderBy("value").collect()
    assert [r["upto"] for r in got] == np.cumsum([r["n"] for r in got]).tolist()
    assert got[-1]["upto"] == 1000


def test_cdf_steps_on_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", float("nan")), ("a", 2.0), ("a", None)], "g string, v double")
    assert sorted((r["value"], round(r["cdf"], 6)) for r in Q.cdf_table(df, ["g"], "v").collect()) == [
        (1.0, 0.333333), (1.0, 0.666667), (2.0, 1.0),
    ]


EDGES = [0.0, 10.0, 20.0, 30.0]


def test_token_round_trip(spark):
    df = spark.createDataFrame([([5.0, 10.0, 10.5, 99.0, 0.0, float("nan"), None, -3.0],)], "v array<double>")
    ids = T.encode_global(F.col("v"), EDGES, n_special=3, n_tokens=100)
    assert df.select(ids).first()[0] == [4, 4, 5, 7, 0, 0, 0, 0]
    own = df.select(T.decode_global(ids, EDGES, n_special=3)).first()[0]
    up = df.select(T.decode_global(ids, EDGES, n_special=3, decode="reference")).first()[0]
    assert own[:3] == [5.0, 5.0, 15.0] and up[:3] == [15.0, 15.0, 25.0]


@pytest.mark.parametrize("n", [1, 31, 33, 64, 257])
def test_edge_search_sizes(spark, n):
    edges = [float(i * 2) for i in range(n)]
    values = [v / 2 for v in range(1, 4 * n + 10)]
    df = spark.createDataFrame([(values,)], "v array<double>")
    got = df.select(T.encode_global(F.col("v"), edges, n_special=0, n_tokens=10_000, pad=-1)).first()[0]
    assert got == np.searchsorted(edges, values, side="left").tolist()


def test_local_bins(spark):
    values = [4.0, 8.0, 15.0, 16.0, 23.0, 42.0, 0.0]
    df = spark.createDataFrame([(values,)], "v array<double>")
    edges = np.quantile([v for v in values if v > 0], [0.25, 0.5, 0.75])
    got = df.select(T.local_edges(F.col("v"), 4)).first()[0]
    assert got == pytest.approx(edges.tolist())
    ids = df.select(T.encode_local(F.col("v"), T.local_edges(F.col("v"), 4), bins=4, n_special=2, n_tokens=50)).first()[0]
    assert ids == [*(np.searchsorted(edges, values[:-1]) + 2).tolist(), 0]
    none = df.select(T.encode_local(F.col("v"), T.local_edges(F.col("v"), 4), bins=0, n_special=2, n_tokens=50)).first()[0]
    assert none == [2] * 6 + [0]


def test_integer_bins(spark):
    df = spark.createDataFrame([([-1.0, 0.0, 0.5, 1.5, 99.0, float("inf")],)], "v array<double>")
    ids = T.encode_integer(F.col("v"), bins=10, n_special=3, n_tokens=100)
    assert df.select(ids).first()[0] == [0, 3, 3, 5, 12, 0]
    assert df.select(T.decode_integer(ids, bins=10, n_special=3)).first()[0][1:5] == [0.0, 0.0, 2.0, 9.0]
    assert T.auto_bins(df.select(F.array(F.lit(0.0), F.lit(6.2)).alias("v")), "v", 4096).first()[0] == 8


def test_next_step(spark):
    df = spark.createDataFrame([([5, 6, 0, 7],), ([5],), ([],)], "t array<int>")
    got = [r[0] for r in df.select(T.next_step_pairs(F.col("t"), skip=1)).collect()]
    assert [tuple(p) for p in got[0]] == [(0, 5, 6, False), (1, 6, 0, False), (2, 0, 7, True)]
    assert got[1] == [] and got[2] == []


def test_series_inputs_hold_every_bin_and_burst(spark, sf):
    """No cut: the dense series and bursts of the registered inputs add up to the raw events."""
    from burstseries.plans import inputs as src

    bins = src.hourly(spark, sf)
    kept = src.series(spark, sf)
    users = {r["user_id"] for r in kept.select("user_id").collect()}
    raw = {}
    for r in bins.collect():
        if r["user_id"] in users:
            raw.setdefault(r["user_id"], []).append((r["bin"], r["inbound"]))
    for r in kept.collect():
        rows = raw[r["user_id"]]
        assert len(r["inbound"]) == max(b for b, _ in rows) - min(b for b, _ in rows) + 1
        assert sum(r["inbound"]) == sum(v for _, v in rows if v >= src.THRESHOLD)
    for r in src.bursts(spark, sf).collect():
        assert sum(r["bi"]) == sum(v for _, v in raw[r["user_id"]] if v >= src.THRESHOLD)
        assert len(r["bi"]) == sum(v >= src.THRESHOLD for _, v in raw[r["user_id"]])


def test_midpoints_fill_open_gaps_only():
    from burstseries.operators.quantiles import fill_midpoints

    assert fill_midpoints([0, 4, 5], 4) == [0, 2, 4, 5]
    assert fill_midpoints([0, 8, 20], 5) == [0, 4, 8, 14, 20]
    assert fill_midpoints([0, 8, 20], 4) == [0, 4, 8, 20]
    assert fill_midpoints([0, 1, 2], 9) == [0, 1, 2]
