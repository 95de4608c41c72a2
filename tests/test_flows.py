import pytest
from pyspark.sql import functions as F

from burstseries.operators import flows, keys, sessions
from burstseries.operators.bursts import audit_totals, rtt_mean, sampling_audit

PACKET = "src_ip string, dst_ip string, src_port int, dst_port int, timestamp double, size int, source_file string"


def packets(spark):
    rows = [
        ("10.0.0.1", "10.0.1.2", 51000, 443, 0.05, 100, "a"),
        ("10.0.1.2", "10.0.0.1", 443, 51000, 0.12, 700, "a"),
        ("10.0.0.1", "10.0.1.2", None, 53, 0.31, 40, "a"),
        ("127.0.0.1", "10.0.1.2", 1, 2, 0.4, 9, "a"),
        (None, "10.0.1.2", 1, 2, 0.4, 9, "a"),
        ("10.0.0.1", "10.0.1.2", 51000, 443, 0.05, 5, "b"),
    ]
    return spark.createDataFrame(rows, PACKET)


def test_service_port_rules(spark):
    df = spark.createDataFrame([(443, 51000), (None, 53), (None, None), (9, 9)], "s int, d int")
    s, d = F.col("s"), F.col("d")
    got = df.select(
        flows.service_port_filled(s, d), flows.service_port_flow(s, d), flows.service_port_known(s, d)
    ).collect()
    assert [tuple(r) for r in got] == [(443, 443, 443), (0, 53, 53), (0, None, None), (9, 9, 9)]


def test_two_sided_aggregate(spark):
    ticks = flows.entity_ticks(flows.both_ends(flows.packet_bytes(packets(spark))))
    got = {tuple(r) for r in ticks.collect()}
    # (tick, ip, port, source, in, out); port 0 rows have no outbound side as 53 != 0
    assert (0, "10.0.0.1", 443, "a", 0, 100) in got
    assert (0, "10.0.1.2", 443, "a", 100, 0) in got
    assert (1, "10.0.1.2", 443, "a", 700, 0) in got
    assert (1, "10.0.0.1", 443, "a", 0, 700) in got
    assert (3, "10.0.0.1", 0, "a", 40, 0) in got
    assert (0, "10.0.0.1", 443, "b", 0, 5) in got
    assert len(got) == 8


def test_levels_keep_totals(spark):
    ticks = flows.entity_ticks(flows.both_ends(flows.packet_bytes(packets(spark))))
    bins = flows.level_bins(ticks, 1000)
    sums = {r["level"]: r["s"] for r in bins.groupBy("level").agg(F.sum("total_inbound_bytes").alias("s")).collect()}
    whole = ticks.agg(F.sum("total_inbound_bytes")).first()[0]
    assert sums == {"ip": whole, "ip_service": whole, "subnet": whole}
    row = bins.filter("level = 'subnet' and source_file = 'b' and subnet = '10.0.0'").first()
    assert row["ip"] is None and row["service_port"] is None and row["total_outbound_bytes"] == 5


def test_bin_size_is_checked():
    assert flows.bin_factor(1000) == 10
    for bad in (50, 150):
        with pytest.raises(ValueError):
            flows.bin_factor(bad)


def test_rank_modes(spark):
    cols = "window_start long, ip string, service_port long, source_file string, total_inbound_bytes long, total_outbound_bytes long"
    rows = [(0, "x", 80, "a", 5, 5), (1, "x", 80, "a", 1, 0), (0, "x", 22, "a", 7, 0), (0, "x", None, "a", 10, 0)]
    df = spark.createDataFrame(rows, cols)
    by_row = {(r[0], r[4], r[5]): r[2] for r in flows.rank_ports(df).collect()}
    assert by_row == {(0, 5, 5): 1, (0, 10, 0): 1, (0, 7, 0): 2, (1, 1, 0): 3}
    by_port = sorted((r[2], r[4]) for r in flows.rank_ports(df, "port_total").collect())
    assert by_port == [(1, 1), (1, 5), (2, 10), (3, 7)]


def test_sessions_split_after_the_gap(spark):
    rows = [("k", t) for t in (0, 300, 601, 601, 10_000)] + [("other", 5)]
    df = spark.createDataFrame(rows, "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sessions.label_events(df, ["k"], "ts", 300).select("k", "t", "session_id").collect()
    assert sorted(map(tuple, got)) == [
        ("k", 0, 0), ("k", 300, 0), ("k", 601, 1), ("k", 601, 1), ("k", 10_000, 2), ("other", 5, 0),
    ]


@pytest.mark.parametrize("chunk", [1, 7, 100, 10_000, 10**9])
def test_sessions_do_not_depend_on_chunks(spark, chunk):
    times = [0, 1, 5, 305, 306, 700, 2000, 2300, 2301, 9999]
    df = spark.createDataFrame([("a", t, 1.0) for t in times], "k string, second long, value_sum double")
    got = sessions.sessionize(df, ["k"], 300, chunk).orderBy("second").select("session_id").collect()
    assert [r[0] for r in got] == [0, 0, 0, 0, 0, 1, 2, 2, 2, 3]


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 0), (None, 500), ("a", 3)], "k string, second long")
    got = sessions.sessionize(df, ["k"], 300).collect()
    assert sorted((r["k"] or "", r["second"], r["session_id"]) for r in got) == [("", 0, 0), ("", 500, 1), ("a", 3, 0)]


def test_windows_and_minimum(spark):
    seconds = spark.createDataFrame(
        [("a", s, 1.0, 0) for s in (0, 10, 70, 130)] + [("b", 0, 4.0, 0)],
        "k string, second long, value_sum double, session_id long",
    )
    wins = sessions.session_windows(seconds, ["k"], 60)
    assert sorted(r["sum_value"] for r in wins.filter("k = 'a'").collect()) == [1.0, 1.0, 2.0]
    kept = sessions.keep_long_sessions(wins, ["k"], 3)
    assert {r["k"] for r in kept.collect()} == {"a"}


def test_timestamps(spark):
    texts = [
        ("2026-03-23T22:18:56.000338Z", 56.000338),
        ("2026-03-23T22:18:56.679874123+00:00", 56.679874),
        ("2026-03-23T22:18:56", 56.0),
        ("soon", None),
        (None, None),
    ]
    df = spark.createDataFrame(texts, "t string, want double")
    got = df.select(sessions.parse_timestamp(F.col("t")).alias("ts"), "want").collect()
    for ts, want in got:
        if want is None:
            assert ts is None
        else:
            assert abs(ts.second + ts.microsecond / 1e6 - want) < 1e-9


def test_ping_text(spark):
    df = spark.createDataFrame(
        [("rtt min/avg/max/mdev = 1.0/2.5/3.0/0.1 ms",), ("100% loss",), ("rtt min/avg/max/mdev = a/b/c/d ms",), (None,)],
        "p string",
    )
    assert [r[0] for r in df.select(rtt_mean(F.col("p"))).collect()] == [2.5, None, None, None]


def test_sampling_audit(spark):
    rows = [("a", t) for t in (0, 180, 180, 540)] + [("b", 7)]
    audit = sampling_audit(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", 180)
    got = audit.first()
    assert (got["k"], got["interval_count"], got["non_expected_count"]) == ("a", 3, 2)
    assert (got["min_interval_sec"], got["max_interval_sec"], got["avg_interval_sec"]) == (0, 360, 180.0)
    totals = audit_totals(audit).first()
    assert tuple(totals) == (1, 3, 2, 1)
    with pytest.raises(Exception, match="unexpected sampling"):
        audit_totals(audit, strict=True).collect()


def test_key_helpers(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", f"10.0.{i}.1") for i in range(9)], "i int, k string, ip string")
    parts = [keys.hash_shard(df, ["i"], 3, n).count() for n in range(3)]
    assert sum(parts) == 9
    assert {r["k"] for r in keys.first_k_keys(df, ["k"], 2).collect()} == {"k0", "k1"}
    allow = spark.createDataFrame([("k1",), ("k1",)], "k string")
    assert keys.allow_listed(df, allow, ["k"]).count() == 3
    ids = keys.unique_point_id(df, ["k"], "i").select("point_id").collect()
    assert len({r[0] for r in ids}) == 9
    sample = keys.member_sample(df, "k", ["i"], 2)
    assert {r["n"] for r in sample.groupBy("k").agg(F.count("*").alias("n")).collect()} == {2}


def test_unique_right_side(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in keys.left_join_unique(left, good, ["k"]).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="repeats a key"):
        keys.left_join_unique(left, good.union(good), ["k"]).collect()


def test_member_lookup_rules(spark):
    members = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "3")], "grp string, id string")
    series = spark.createDataFrame(
        [(1, 0, [1.0, -1.0, None, 2.0]), (1, 1, [9.0]), (2, 0, [float("nan"), 1.0])], "id int, o int, s array<double>"
    )
    got = keys.member_lookup(members, series, ["id"], "s", ["o"])
    rows = {r["id"]: r for r in got.collect()}
    assert rows["1"]["s"] == [1.0, 2.0] and not rows["2"]["found"] and not rows["3"]["found"]
    counts = {r["grp"]: (r["found"], r["missing"]) for r in keys.member_counts(got, "grp").collect()}
    assert counts == {"g": (1, 1), "h": (0, 1), None: (1, 2)}


def test_levels_share_one_shuffle(spark):
    """All three levels of the bins are summed where one shuffle has put the rows."""
    df = spark.range(100).selectExpr(
        "id as window_start", "concat('10.0.', id % 3, '.', id % 7) as ip", "id % 5 as service_port", "concat('f', id % 2) as source_file",
        "id as total_inbound_bytes", "id as total_outbound_bytes",
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = flows.level_bins(df, 1000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.replace("ReusedExchange", "").count("Exchange hashpartitioning") - plan.count("ReusedExchange") == 1, plan


def test_port_ranks_take_one_shuffle(spark):
    """Ranks of addresses that are not hot come from one shuffle of the rows by address, without a join."""
    df = spark.range(200).selectExpr(
        "id % 20 as window_start", "concat('10.0.0.', id % 6) as ip", "id % 5 as service_port", "'f' as source_file",
        "id as total_inbound_bytes", "id as total_outbound_bytes",
    )
    for how in ("row", "port_total"):
        plan = flows.rank_ports(df, how)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan
