import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstseries.operators import distances as D
from burstseries.operators import forecast as P
from burstseries.operators import retrieval as R
from burstseries.plans import workflows
from burstseries.sources import files, packets, sinks
from burstseries.streaming import incremental as ST

rng = np.random.default_rng(11)
VEC = rng.normal(size=(120, 6))
VEC /= np.linalg.norm(VEC, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def sides(spark):
    rows = [(i, int(i % 3 == 0), list(map(float, v))) for i, v in enumerate(VEC)]
    df = spark.createDataFrame(rows, "id_ long, cluster_id int, vector array<double>")
    q = df.filter("id_ < 15").withColumnRenamed("id_", "query_id")
    b = df.filter("id_ >= 15").withColumnRenamed("id_", "base_id")
    return q, b


def best(q, allowed, k):
    score = VEC[q] @ VEC[allowed].T
    return [int(allowed[i]) for i in np.argsort(-score, kind="stable")[:k]]


@pytest.mark.parametrize(("block", "limit"), [(7, 0), (10_000, 0), (7, 10**9)])
def test_exact_search_on_both_ways(sides, block, limit):
    q, b = sides
    got: dict = {}
    for r in R.exact_search(q, b, 4, block_rows=block, broadcast_bytes=limit).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["base_id"])
    for i in range(15):
        assert got[i] == best(i, np.arange(15, 120), 4)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_ties_go_to_the_smaller_id(spark, limit):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    b = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "base_id long, vector array<double>")
    got = R.exact_search(q, b.repartition(3), 3, block_rows=8, broadcast_bytes=limit).orderBy("rank").collect()
    assert [r["base_id"] for r in got] == [0, 1, 2]


def test_search_inside_clusters_and_padding(spark, sides):
    q, b = sides
    hits = R.cluster_search(q, b, 3, block_rows=9, broadcast_bytes=0)
    for r in hits.filter("rank = 1").collect():
        same = np.array([i for i in range(15, 120) if (i % 3 == 0) == bool(r["cluster_id"])])
        assert r["base_id"] == best(r["query_id"], same, 1)[0]
    lone = b.filter("base_id = 15")
    slots = R.padded_neighbors(q, R.cluster_search(q, lone, 3), 3, "query_id", "base_id")
    assert slots.count() == 45
    assert slots.filter("base_id is not null").count() == 5
    assert {r["neighbor_count"] for r in slots.collect()} == {0, 1}


def test_lists_with_all_probes_are_exact(spark, sides):
    q, b = sides
    lists = R.train_lists(b, 6, max_iter=5).cache()
    assigned = R.assign_lists(b, lists)
    full = R.search_lists(q, assigned, lists, 3, 6).select("query_id", "rank", "base_id")
    exact = R.exact_search(q, b, 3).select("query_id", "rank", "base_id")
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, exact.collect()))
    other = R.with_nearest_lists(b, lists, 2, row_id="base_id", broadcast_bytes=0)
    near = R.with_nearest_lists(b, lists, 2, row_id="base_id")
    cols = ["base_id", "list_id", "probe_rank"]
    assert sorted(map(tuple, other.select(*cols).collect())) == sorted(map(tuple, near.select(*cols).collect()))
    few = R.search_lists(q, assigned, lists, 3, 1, cluster="cluster_id")
    assert few.filter("probe_rank <> 1").count() == 0
    grid = R.probe_grid(q, assigned, lists, [2, 2, 0, 6])
    assert {r["n_probe"] for r in grid.collect()} == {2, 6}
    top = {r["query_id"]: r["base_id"] for r in exact.filter("rank = 1").collect()}
    assert all(r["neighbor_id"] == top[r["query_id"]] for r in grid.filter("n_probe = 6").collect())
    changes = {r["n_probe"]: r for r in R.probe_changes(grid, 2).collect()}
    assert changes[2]["neighbor_changed"] == 0


def test_manifest(spark):
    df = spark.createDataFrame([(i, "x", f"s{i % 7}", i % 2) for i in range(40)], "row_id long, ip string, source_file string, label int")
    m = R.split_manifest(df, ["ip", "source_file"], "row_id", "label", n_eval=6)
    rows = m.collect()
    train = sorted(r["train_id"] for r in rows if r["split"] == "train")
    assert train == list(range(34)) and sum(r["train_id"] == -1 for r in rows) == 6
    assert len({r["point_id"] for r in rows}) == 40
    same = R.split_manifest(df.repartition(9), ["ip", "source_file"], "row_id", "label", n_eval=6)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows))
    tiny = R.split_manifest(df.filter("row_id < 3"), ["ip"], "row_id", "label", fraction=0.99)
    assert tiny.filter("split = 'eval'").count() == 2
    with pytest.raises(Exception, match="n_eval must be under"):
        R.split_manifest(df, ["ip"], "row_id", "label", n_eval=40).collect()
    assert R.train_id_map(m).count() == 34


def pair(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<double>, b array<double>")


def test_time_wasserstein_cases(spark):
    f = D.time_wasserstein(F.col("a"), F.col("b"))
    assert pair(spark, [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]).select(f).first()[0] == pytest.approx(1.0)
    assert pair(spark, [1.0, 1.0, 1.0], [0.0, 0.0, 3.0]).select(f).first()[0] == pytest.approx(1.0)
    assert pair(spark, [1.0, 2.0], [1.0, 2.0, 9.0]).select(f).first()[0] == pytest.approx(0.0)
    assert pair(spark, [], [1.0]).select(f).first()[0] is None


def test_value_wasserstein(spark):
    f = D.value_wasserstein(F.col("a"), F.col("b"))
    assert pair(spark, [1.0, 5.0, 3.0], [2.0, 2.0, 9.0]).select(f).first()[0] == pytest.approx(2.0)
    g = D.value_wasserstein(F.col("b"), F.col("a"))
    assert pair(spark, [1.0, 5.0, 3.0], [2.0, 2.0, 9.0]).select(g).first()[0] == pytest.approx(2.0)


def plain_dtw(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i, j] = abs(x - y) + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
    return t[-1, -1]


def test_warping():
    assert D.warp_distance(np.array([0.0, 1, 2]), np.array([0.0, 1, 1])) == 1
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 7), (9, 4), (30, 31)):
        a, b = r.normal(size=n), r.normal(size=m)
        assert D.warp_distance(a, b) == pytest.approx(plain_dtw(a, b))
        if n == m:
            assert D.warp_distance(a, b) <= np.abs(a - b).sum() + 1e-12
    assert np.isnan(D.warp_distance(np.array([]), np.array([1.0])))


def test_distance_rows(spark):
    n = spark.createDataFrame(
        [("q", "b", 0, 1, 2), ("q", "gone", 0, 2, 2), ("q", None, 0, 3, 2), ("lost", "b", 1, 1, 1)],
        "test_point_id string, neighbor_id string, cluster_id int, rank int, neighbor_count long",
    )
    s = spark.createDataFrame([("q", [1.0, 0.0, 4e6]), ("b", [1.0, 2e6, 4e6])], "point_id string, series array<double>")
    got = {(r["test_point_id"], r["rank"]): r for r in D.distance_rows(n, s).collect()}
    one = got["q", 1]
    z = lambda x: (x - x.mean()) / x.std()
    a, b = np.array([1.0, 0, 4e6]), np.array([1.0, 0, 4e6])
    assert one["dtw_distance_normalized"] == pytest.approx(plain_dtw(z(a), z(b)), abs=1e-9)
    assert one["dtw_distance_unnormalized"] == pytest.approx(plain_dtw([1e-6, 0, 4], [1e-6, 2, 4]))
    assert got["q", 2]["wasserstein_distance"] is None
    assert got["q", 3]["neighbor_id"] == R.PAD_ID
    rep = R.sanity_report(D.distance_rows(n, s), ["wasserstein_distance_normalized"]).first()
    assert tuple(rep) == (2, 4, 1, 1, 1, 1)


CASE = "k string, context_bi array<double>, context_ibg array<double>, gt_bi array<double>, gt_ibg array<double>, pred_bi array<double>, pred_ibg array<double>"


def test_forecast_metrics(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0], [0.0, 1.0], [4.0, 0.0, 2.0], [1.0, 2.0, 1.0], [5.0, 1.0, 2.0], [1.0, 1.0, 1.0])], CASE)
    got = P.burst_metrics(df, ["k"]).first()
    assert got["MAE_BI"] == pytest.approx(2 / 3) and got["NZ_MAE_BI"] == pytest.approx(0.5)
    assert got["NZ_SCALED_BI"] == pytest.approx(0.125) and got["fano_input_bi"] == pytest.approx(0.5)
    g, p = np.array([4.01, 0.01, 2.01]), np.array([5.01, 0.01, 2.01])
    want = np.abs(np.cumsum(g / g.sum()) - np.cumsum(p / p.sum()))[:-1].sum()
    assert got["WD_BI"] == pytest.approx(want)
    m = P.merged_metrics(df, ["k"]).first()
    # truth 4 | 0 0 | 2, forecast 5 | 1 | 2: three common slots
    assert (m["merged_len"], m["bursts_used"]) == (4, 3)
    assert m["MAE_EXPANDED_MERGED"] == pytest.approx((1 + 1 + 2) / 3)
    short = P.merged_metrics(df, ["k"], prefix=1).first()
    assert (short["merged_len"], short["bursts_used"], short["MAE_EXPANDED_MERGED"]) == (1, 1, 1.0)
    assert df.select(P.percent_mape(F.col("pred_bi"), F.col("gt_bi"))).first()[0] == pytest.approx(12.5)


def test_threshold_skips_silent_truth(spark):
    df = spark.createDataFrame([("a", [1.0], [1.0], [4.0], [1.0], [9.0], [1.0]), ("b", [1.0], [1.0], [40.0], [1.0], [9.0], [1.0])], CASE)
    got = P.burst_metrics(df, ["k"], threshold=10.0).collect()
    assert [(r["k"], r["MAE_BI"]) for r in got] == [("b", 40.0)]


def test_report_leaves_missing_values_out(spark):
    cols = [*P.MEANS]
    rows = [tuple([1.0] * len(cols)), tuple([float("nan")] * len(cols)), tuple([3.0] * len(cols))]
    got = P.metric_report(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))).first()
    assert got["num_series_test"] == 3 and got["mean_MAE_BI"] == 2.0 and got["median_WD"] == 2.0 and len(got) == 24


def test_token_accuracy(spark):
    df = spark.createDataFrame([([3, 4, 5], [3, 4, 0], [7], [8])], "gt_tok_bi array<int>, pred_tok_bi array<int>, gt_tok_ibg array<int>, pred_tok_ibg array<int>")
    got = P.token_accuracy(df).first()
    assert got["accuracy_bi"] == pytest.approx(2 / 3) and got["accuracy_ibg"] == 0 and got["accuracy"] == 0.5
    assert P.token_accuracy(df, skip=2).first()["n_positions"] == 1


def test_predictors(spark):
    df = spark.createDataFrame([(i, [1.0, 5.0, 9.0, 9.0], [0.0, 2.0, 2.0, 2.0], [7.0, 7.0], [1.0, 1.0]) for i in range(6)], "k int, context_bi array<double>, context_ibg array<double>, gt_bi array<double>, gt_ibg array<double>")
    assert P.predict_last(df).first()["pred_bi"] == [9.0, 9.0]
    assert P.predict_median(df).first()["pred_bi"] == [5.0, 5.0]
    a = sorted(map(tuple, P.predict_resampled(df.repartition(1), ["k"]).select("k", F.to_json("pred_bi")).collect()))
    b = sorted(map(tuple, P.predict_resampled(df.repartition(4), ["k"]).select("k", F.to_json("pred_bi")).collect()))
    assert a == b
    e = P.embed_batches(df, ["k"], lambda f: np.ones((len(f), 2)), 2)
    assert e.columns == ["k", "repr_dim_0", "repr_dim_1"] and e.count() == 6


# ---- files --------------------------------------------------------------------------------


def test_files_round_trip(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b/c")], "x int, cluster string")
    sinks.write_products({"p": df, "tree/task_0": df, "tree/task_1": df}, root)
    (tmp_path / "tree" / "notes.txt").write_text("not data")
    assert files.scan_shards(spark, f"{root}/tree").count() == 4
    assert files.scan_shards(spark, f"{root}/tree/task_*").count() == 4
    assert files.resolve_root(spark, f"{root}/tree/task", ["9", "1"]).endswith("task_1")
    with pytest.raises(FileNotFoundError):
        files.resolve_root(spark, f"{root}/nothing", ["a"])
    assert files.scan_globs(spark, [f"{root}/tree", f"{root}/tree"]).count() == 4
    assert files.scan_table(spark, f"{root}/p").count() == 2
    two = files.scan_roots(spark, {"one": f"{root}/p", "two": f"{root}/p"})
    assert {(r["source_file"], r["count"]) for r in two.groupBy("source_file").count().collect()} == {("one", 2), ("two", 2)}
    sinks.write_per_cluster(df.withColumnRenamed("cluster", "c"), f"{root}/per", "c")
    assert {p.name for p in (tmp_path / "per").iterdir() if p.is_dir()} == {"cluster=a", "cluster=b_c"}
    many = spark.range(60_000).repartition(24).withColumn("c", F.when(F.col("id") % 10 > 0, "hot").otherwise((F.col("id") % 3).cast("string")))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    sinks.write_per_cluster(many, f"{root}/many", "c", "json")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
    assert spark.read.json(f"{root}/many").select("id").distinct().count() == 60_000
    parts = {p.name: len(list(p.glob("part-*"))) for p in (tmp_path / "many").glob("cluster=*")}
    assert parts["cluster=hot"] >= 3 and sum(parts.values()) < 24, parts  # of 24 tasks, each with all clusters
    sinks.write_result(df, f"{root}/r.json", "json")
    assert files.scan_table(spark, f"{root}/r.json").count() == 2


def test_csv_names_and_required(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "x.csv").write_text("Label , Time,Ping\nh,2026-01-01 00:00:00,rtt\n")
    got = files.scan_csv(spark, str(d), ["label", "time", "ping"]).first()
    assert got["label"] == "h" and got["source_file"].endswith("x.csv")
    with pytest.raises(ValueError, match="size"):
        files.scan_csv(spark, str(d), ["size"])
    assert files.flat_name("@meta.dst_ip") == "meta_dst_ip"


def test_member_list_files(spark, tmp_path):
    for g, ids in (("g1", ["1", "2"]), ("g2", ["3"])):
        (tmp_path / g).mkdir()
        (tmp_path / g / "members.json").write_text("[" + ",\n".join(f'{{"id": "{i}"}}' for i in ids) + "]")
    got = files.scan_member_lists(spark, f"{tmp_path}/*/members.json", ["id"])
    assert sorted(map(tuple, got.collect())) == [("g1", "1"), ("g1", "2"), ("g2", "3")]


def frame(src, dst, proto, sport, dport, vlan=False):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40, 0, 0, 64, proto, 0, bytes(src), bytes(dst))
    tag = b"\x81\x00\x00\x05" if vlan else b""
    return b"\0" * 12 + tag + b"\x08\x00" + ip + struct.pack(">HH", sport, dport) + b"\0" * 16


def capture(frames, order="<", cut=0):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1000 + i, 250_000, len(f), len(f) + 100) + f
    return out[: len(out) - cut] if cut else out


def test_capture_files(spark, tmp_path):
    good = [frame((10, 0, 0, 1), (10, 0, 0, 2), 6, 443, 5), frame((10, 0, 0, 3), (10, 0, 0, 4), 17, 53, 7, vlan=True), frame((1, 2, 3, 4), (5, 6, 7, 8), 1, 9, 9), b"\0" * 60]
    (tmp_path / "a.pcap").write_bytes(capture(good))
    (tmp_path / "b.pcap").write_bytes(capture(good[:2], order=">", cut=3))
    (tmp_path / "c.pcap").write_bytes(b"garbage")
    (tmp_path / "d.txt").write_bytes(capture(good))
    rows = packets.scan_captures(spark, str(tmp_path)).collect()
    by = {(r["source_file"][-6:], r["src_ip"]): r for r in rows}
    assert len(rows) == 4
    a = by["a.pcap", "10.0.0.1"]
    assert (a["dst_ip"], a["src_port"], a["dst_port"], a["timestamp"]) == ("10.0.0.2", 443, 5, 1000.25)
    assert a["size"] == len(good[0]) + 100
    assert by["a.pcap", "10.0.0.3"]["dst_port"] == 7
    assert by["a.pcap", "1.2.3.4"]["src_port"] is None
    assert ("b.pcap", "10.0.0.1") in by and ("b.pcap", "10.0.0.3") not in by


# ---- streams and workflows ----------------------------------------------------------------


def test_streams_equal_batches_over_several_files(spark, tmp_path):
    from burstseries.operators import bursts as B

    rows = [("a" if i % 3 else "b", 1_700_000_000 + i * 97 + (i // 40) * 4000, float(i % 7)) for i in range(200)]
    for n in range(4):
        part = spark.createDataFrame(rows[n * 50 : (n + 1) * 50], "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, s long, v double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    df = spark.createDataFrame(rows, "k string, s long, v double")
    bins = df.groupBy("k", F.floor(F.col("s") / 300).cast("long").alias("bin")).agg(F.sum("v").alias("v"))
    want = B.burst_rows(bins, ["k"], "v", threshold=3.0).select("k", "bin", "bi", "ibg").collect()
    got = ST.all_bursts(stream, ["k"], "ts", "v", 300, 3.0, "2 hours")
    assert sorted(map(tuple, got.select("k", "bin", "bi", "ibg").collect())) == sorted(map(tuple, want))
    got = ST.all_tumbling_sums(stream, ["k"], "ts", "v", "10 minutes", "2 hours").select("k", F.unix_seconds("window_start"), "sum_value", "n")
    sums = df.groupBy("k", (F.floor(F.col("s") / 600) * 600).alias("w")).agg(F.sum("v"), F.count("*"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sums.collect()))
    got = ST.all_gap_sessions(stream, ["k"], "ts", "v", 1800, "2 hours").select("k", F.unix_seconds("session_start"), F.unix_seconds("session_last"), "n_events", "sum_value")
    sessions = []
    for k in ("a", "b"):
        mine = sorted(r for r in rows if r[0] == k)
        cuts = [0, *[i for i in range(1, len(mine)) if mine[i][1] - mine[i - 1][1] > 1800], len(mine)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            part = mine[x:y]
            sessions.append((k, part[0][1], part[-1][1], len(part), sum(p[2] for p in part)))
    assert sorted(map(tuple, got.collect())) == sorted(sessions)


def test_idle_keys_are_forgotten_by_a_timer(spark, tmp_path):
    """The key's state goes once the watermark is an hour past its last bin, so its next burst has no gap."""
    spots = [("a", 0), ("a", 600), ("b", 9_000), ("b", 20_000), ("a", 20_500), ("b", 60_000)]
    for n, (k, at) in enumerate(spots):
        part = spark.createDataFrame([(k, 1_700_000_100 + at, 5.0)], "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, s long, v double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ST.burst_stream(stream, ["k"], "ts", "v", 300, 3.0, "0 seconds", idle_seconds=3600)
    got = ST.closed_rows(out, spark, ST.run(out, spark, "t-idle")).orderBy("k", "bin").collect()
    assert [(r["k"], r["ibg"]) for r in got] == [("a", 0), ("a", 2), ("a", 0), ("b", 0), ("b", 0)]


def test_workflows_end_to_end(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = []
    for i in range(12):
        for t in np.sort(r.integers(0, 400, 60)):
            rows.append((f"10.0.{i % 2}.{i}", "10.9.9.9", 50_000, 443, float(t), int(r.integers(50, 900)), "cap"))
    p = spark.createDataFrame(rows, "src_ip string, dst_ip string, src_port int, dst_port int, timestamp double, size int, source_file string")
    out = str(tmp_path / "series")
    series = workflows.packets_to_series(p, out, bin_ms=1000, threshold=100, min_len=3)
    assert series["ip"].count() == 13 and series["subnet"].count() == 3 and series["ip2ip"].count() == 12
    q = spark.read.parquet(f"{out}/quantiles")
    assert workflows.resolve_threshold(q, "ip", 1.0) >= workflows.resolve_threshold(q, "ip", 0.5)
    keys = ["ip", "source_file"]
    sent = series["ip"].filter("ip <> '10.9.9.9'").withColumn("inbound", F.col("outbound"))
    workflows.series_to_splits(sent, keys, str(tmp_path / "splits"), threshold=100)
    meta = spark.read.parquet(str(tmp_path / "splits" / "splits_meta"))
    assert meta.count() == 12
    workflows.series_to_splits(sent, keys, str(tmp_path / "again"), threshold=100, existing_meta=meta)
    from burstseries.operators.features import minimal_features

    feats = minimal_features(sent, keys, "inbound")
    labels = sent.select(
        *keys,
        F.pmod(F.hash("ip"), F.lit(2)).alias("label"),
        (F.size("inbound") / 100.0).alias("repr_dim_0"),
        F.get("inbound", F.lit(0)).cast("double").alias("repr_dim_1"),
    )
    workflows.explain_clusters(labels, feats, str(tmp_path / "explain"), keys=keys, min_cluster_size=1, at_least=0.0, top_k=3)
    assert spark.read.parquet(str(tmp_path / "explain" / "cluster_importance")).count() == 2
    reps = labels.withColumns({"vector": F.array("repr_dim_0", "repr_dim_1"), "row_id": F.xxhash64(*keys)})
    named = sent.select(F.concat_ws("::", *keys).alias("point_id"), F.col("inbound").cast("array<double>").alias("series"))
    workflows.evaluate_retrieval(reps, named, str(tmp_path / "search"), n_eval=3, fraction=None, n_lists=3, n_probe=2, top_k=2)
    rep = spark.read.parquet(str(tmp_path / "search" / "sanity")).first()
    assert rep["n_queries"] == 3 and rep["n_rows"] == 6 and rep["missing_eval_series"] == 0


def test_small_blocks_share_a_cell(spark):
    """Blocks of two rows do not send each row once per block of the other side; the result is the broadcast form's."""
    from pyspark.sql import functions as F

    from burstseries.operators.retrieval import block_top_k

    v = F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("vector")
    queries = spark.range(30).select(F.col("id").alias("query_id"), v)
    base = spark.range(100, 200).select(F.col("id").alias("base_id"), v)
    sent = block_top_k(queries, base, 3, block_rows=2, broadcast_bytes=0)
    want = block_top_k(queries, base, 3)
    cols = ["query_id", "rank", "base_id"]
    assert sorted(map(tuple, sent.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    from burstseries.operators import retrieval

    one = [d.withColumn("__g", F.lit(0)) for d in (queries, base)]
    found = retrieval._cell_top_k(*one, 3, ["__g"], "query_id", "base_id", "vector", _cell_schema(), 2)
    assert found.count() == 30 * 3


def _cell_schema():
    from pyspark.sql import types as T

    kinds = {"__g": T.IntegerType(), "query_id": T.LongType(), "base_id": T.LongType(), "score": T.DoubleType()}
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])
