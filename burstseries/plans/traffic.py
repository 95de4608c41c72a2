"""Queries over packets, flows, sessions and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstseries.operators import flows, keys, sessions
from burstseries.operators.bursts import audit_totals, rtt_mean, sampling_audit
from burstseries.operators.dense import dense_calendar, mean_bins
from burstseries.plans import inputs as src
from burstseries.plans.registry import query
from burstseries.sources import files


def _ticks(spark, sf):
    return flows.entity_ticks(flows.both_ends(flows.packet_bytes(src.packets(spark, sf))))


@query("flow_two_sided_agg", f"WITH {src.PACKET_BYTES} SELECT * FROM ticks")
def flow_two_sided_agg(spark, sf):
    return _ticks(spark, sf)


@query(
    "service_port_rules",
    f"""WITH {src.PACKETS}
    SELECT source_file, least(coalesce(src_port, 0), coalesce(dst_port, 0)) AS port_filled,
           CASE WHEN src_port < dst_port THEN src_port ELSE dst_port END AS port_flow,
           CAST(CASE WHEN src_port IS NULL THEN dst_port WHEN dst_port IS NULL THEN src_port
                ELSE least(src_port, dst_port) END AS BIGINT) AS port_known,
           count(*) AS n
    FROM packets WHERE NOT starts_with(src_ip, '127.') AND NOT starts_with(dst_ip, '127.') GROUP BY ALL""",
)
def service_port_rules(spark, sf):
    s, d = F.col("src_port"), F.col("dst_port")
    kept = src.packets(spark, sf).filter(flows.not_localhost("src_ip", "dst_ip"))
    return kept.groupBy(
        "source_file",
        flows.service_port_filled(s, d).alias("port_filled"),
        flows.service_port_flow(s, d).alias("port_flow"),
        flows.service_port_known(s, d).alias("port_known"),
    ).agg(F.count(F.lit(1)).alias("n"))


FLOW_TICKS = src.PACKETS + """,
f AS (
  SELECT *, second * 1000 // 604800000 AS window_start,
         CASE WHEN src_port < dst_port THEN src_port ELSE dst_port END AS service_port FROM packets),
fs AS (
  SELECT *, CASE WHEN service_port <> dst_port THEN size ELSE 0 END AS inb,
            CASE WHEN service_port = dst_port THEN size ELSE 0 END AS outb FROM f),
flow_ticks AS (
  SELECT window_start, ip, CAST(service_port AS BIGINT) AS service_port, source_file,
         CAST(sum(i) AS BIGINT) AS total_inbound_bytes, CAST(sum(o) AS BIGINT) AS total_outbound_bytes
  FROM (SELECT window_start, src_ip AS ip, service_port, source_file, inb AS i, outb AS o FROM fs
        UNION ALL SELECT window_start, dst_ip, service_port, source_file, outb, inb FROM fs)
  GROUP BY ALL)"""


def _flow_ticks(spark, sf):
    return flows.entity_ticks(flows.both_ends(flows.flow_bytes(src.packets(spark, sf), src.WEEK_MS)))


@query("flow_window_agg", f"WITH {FLOW_TICKS} SELECT * FROM flow_ticks")
def flow_window_agg(spark, sf):
    return _flow_ticks(spark, sf)


@query(
    "flow_port_rank",
    f"""WITH {FLOW_TICKS}
    SELECT window_start, ip,
           dense_rank() OVER (PARTITION BY ip ORDER BY total_inbound_bytes + total_outbound_bytes DESC) AS service_port,
           source_file, total_inbound_bytes, total_outbound_bytes FROM flow_ticks""",
)
def flow_port_rank(spark, sf):
    return flows.rank_ports(_flow_ticks(spark, sf))


@query(
    "flow_port_rank_total",
    f"""WITH {FLOW_TICKS},
    t AS (SELECT ip, service_port, sum(total_inbound_bytes + total_outbound_bytes) AS b FROM flow_ticks GROUP BY ALL),
    r AS (SELECT ip, service_port, dense_rank() OVER (PARTITION BY ip ORDER BY b DESC) AS rk FROM t)
    SELECT f.window_start, f.ip, r.rk AS service_port, f.source_file, f.total_inbound_bytes, f.total_outbound_bytes
    FROM flow_ticks f JOIN r ON r.ip = f.ip AND r.service_port IS NOT DISTINCT FROM f.service_port""",
)
def flow_port_rank_total(spark, sf):
    return flows.rank_ports(_flow_ticks(spark, sf), rank_by="port_total")


@query(
    "pair_agg",
    f"""WITH {src.PACKET_BYTES}
    SELECT window_start, src_ip, dst_ip, source_file, CAST(sum(size) AS BIGINT) AS total_inbound_bytes,
           CAST(0 AS BIGINT) AS total_outbound_bytes FROM sized GROUP BY ALL""",
)
def pair_agg(spark, sf):
    return flows.pair_ticks(flows.packet_bytes(src.packets(spark, sf)))


@query(
    "unified_ticks",
    f"""WITH {src.PACKET_BYTES}
    SELECT window_start, ip, service_port, source_file, total_inbound_bytes, total_outbound_bytes,
           regexp_extract(ip, '^([^.]*[.][^.]*[.][^.]*)', 1) AS subnet,
           CAST(NULL AS VARCHAR) AS src_ip, CAST(NULL AS VARCHAR) AS dst_ip FROM ticks
    UNION ALL
    SELECT window_start, NULL, NULL, source_file, CAST(sum(size) AS BIGINT), 0, NULL, src_ip, dst_ip
    FROM sized GROUP BY window_start, source_file, src_ip, dst_ip""",
)
def unified_ticks(spark, sf):
    traffic = flows.packet_bytes(src.packets(spark, sf))
    return flows.unified_ticks(flows.entity_ticks(flows.both_ends(traffic)), flows.pair_ticks(traffic))


@query(
    "entity_levels_bins",
    f"""WITH {src.PACKET_BYTES},
    b AS (SELECT *, window_start // 6048000 AS bin, regexp_extract(ip, '^([^.]*[.][^.]*[.][^.]*)', 1) AS subnet FROM ticks)
    SELECT CASE WHEN grouping(subnet) = 0 THEN 'subnet' WHEN grouping(service_port) = 0 THEN 'ip_service' ELSE 'ip' END AS level,
           subnet, ip, service_port, source_file, bin, CAST(sum(total_inbound_bytes) AS BIGINT) AS total_inbound_bytes,
           CAST(sum(total_outbound_bytes) AS BIGINT) AS total_outbound_bytes
    FROM b GROUP BY GROUPING SETS ((ip, source_file, bin), (ip, service_port, source_file, bin), (subnet, source_file, bin))""",
)
def entity_levels_bins(spark, sf):
    return flows.level_bins(_ticks(spark, sf), src.WEEK_MS)


@query(
    "pair_bins",
    f"""WITH {src.PACKET_BYTES}
    SELECT src_ip, dst_ip, source_file, window_start // 6048000 AS bin, CAST(sum(size) AS BIGINT) AS total_inbound_bytes,
           CAST(0 AS BIGINT) AS total_outbound_bytes FROM sized GROUP BY ALL""",
)
def pair_bins(spark, sf):
    return flows.pair_bins(flows.pair_ticks(flows.packet_bytes(src.packets(spark, sf))), src.WEEK_MS)


# ---- sessions -----------------------------------------------------------------------------

GAP = 43_200

SESSIONS = src.EVENTS + f""",
g AS (SELECT *, second - lag(second) OVER (PARTITION BY user_id ORDER BY second, event_id) AS gap FROM ev),
sess AS (
  SELECT *, CAST(sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY second, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id FROM g)"""


@query("session_events", f"WITH {SESSIONS} SELECT event_id, user_id, second, session_id FROM sess")
def session_events(spark, sf):
    ev = src.events(spark, sf, "event_id", "user_id", "ts")
    return sessions.label_events(ev, ["user_id"], "ts", GAP).select("event_id", "user_id", "second", "session_id")


def _sessions(spark, sf):
    ev = src.events(spark, sf, "user_id", "ts", "cents")
    seconds = sessions.second_sums(ev, ["user_id"], "ts", F.col("cents").cast("double"))
    return sessions.sessionize(seconds, ["user_id"], GAP)


@query(
    "sessions_gap",
    f"""WITH {SESSIONS} SELECT user_id, session_id, count(*) AS n_events, min(second) AS first_second,
    max(second) AS last_second FROM sess GROUP BY ALL""",
)
def sessions_gap(spark, sf):
    return (
        _sessions(spark, sf)
        .groupBy("user_id", "session_id")
        .agg(
            F.sum("n_rows").alias("n_events"),
            F.min("second").alias("first_second"),
            F.max("second").alias("last_second"),
        )
    )


WINDOWS = SESSIONS + """,
wins AS (
  SELECT user_id, session_id, second // 3600 * 3600 AS w, sum(cents)::DOUBLE AS sum_value FROM sess GROUP BY ALL)"""


@query(
    "session_windows",
    f"WITH {WINDOWS} SELECT user_id, session_id, make_timestamp(w * 1000000) AS window_start, sum_value FROM wins",
)
def session_windows(spark, sf):
    out = sessions.session_windows(_sessions(spark, sf), ["user_id"], 3_600)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "session_keep",
    f"""WITH {WINDOWS}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id, session_id) AS num_windows FROM wins)
    SELECT user_id, session_id, make_timestamp(w * 1000000) AS window_start, sum_value, num_windows FROM c WHERE num_windows >= 5""",
)
def session_keep(spark, sf):
    wins = sessions.session_windows(_sessions(spark, sf), ["user_id"], 3_600)
    out = sessions.keep_long_sessions(wins, ["user_id"], 5)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "edge_hits_normalised",
    f"""WITH {src.EVENTS}
    SELECT event_id, CAST(user_id AS VARCHAR) AS meta_dst_ip,
           CAST(CASE WHEN event_type = 'click' THEN 80 ELSE least(443, 1000 + user_id) END AS BIGINT) AS service_port,
           ts AS ingest_ts, value AS values_num_bits
    FROM ev WHERE event_type <> 'error'""",
)
def edge_hits_normalised(spark, sf):
    """Dotted names, ISO text with nanoseconds, ports as text: tidied, parsed, rows without time dropped."""
    ev = src.events(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_type")
    raw = ev.select(
        "event_id",
        F.col("user_id").cast("string").alias("meta.dst_ip"),
        F.when(kind == "click", None).otherwise(F.lit(443)).alias("meta.src_port"),
        F.when(kind == "click", F.lit(80)).otherwise(F.lit(1000) + F.col("user_id")).alias("meta.dst_port"),
        F.col("value").cast("string").alias("values.num_bits"),
        F.when(kind == "error", F.lit("not a time"))
        .when(kind == "click", F.concat(stamp, F.lit("123Z")))
        .otherwise(F.concat(stamp, F.lit("+00:00")))
        .alias("@timestamp"),
    )
    flat = files.rename_columns(raw, files.flat_name)
    port = flows.service_port_known(F.col("meta_src_port"), F.col("meta_dst_port"))
    parsed = flat.withColumns(
        {
            "service_port": port,
            "ingest_ts": sessions.parse_timestamp(F.col("timestamp")).cast("timestamp_ntz"),
            "values_num_bits": F.col("values_num_bits").try_cast("double"),
        }
    )
    kept = parsed.filter(
        F.col("meta_dst_ip").isNotNull() & F.col("service_port").isNotNull() & F.col("ingest_ts").isNotNull()
    )
    return kept.select("event_id", "meta_dst_ip", "service_port", "ingest_ts", "values_num_bits")


# ---- samples ------------------------------------------------------------------------------

AUDIT = src.EVENTS + """,
steps AS (SELECT user_id, second - lag(second) OVER (PARTITION BY user_id ORDER BY second) AS step FROM ev),
audit AS (
  SELECT user_id, count(*) AS interval_count, count(*) FILTER (WHERE step <> 3600) AS non_expected_count,
         min(step) AS min_interval_sec, max(step) AS max_interval_sec, sum(step) / count(*) AS avg_interval_sec
  FROM steps WHERE step IS NOT NULL GROUP BY ALL)"""


def _audit(spark, sf):
    return sampling_audit(src.events(spark, sf, "user_id", "second"), ["user_id"], "second", 3_600)


@query(
    "sampling_audit",
    f"""WITH {AUDIT} SELECT user_id, interval_count, non_expected_count, min_interval_sec, max_interval_sec,
    round(avg_interval_sec, 6) AS avg_interval_sec FROM audit""",
)
def sampling_audit_query(spark, sf):
    return _audit(spark, sf).withColumn("avg_interval_sec", F.round("avg_interval_sec", 6))


@query(
    "sampling_audit_totals",
    f"""WITH {AUDIT} SELECT count(*) AS entities_with_intervals, CAST(sum(interval_count) AS BIGINT) AS total_intervals,
    CAST(sum(non_expected_count) AS BIGINT) AS non_expected_total,
    count(*) FILTER (WHERE non_expected_count > 0) AS entities_with_non_expected FROM audit""",
)
def sampling_audit_totals(spark, sf):
    return audit_totals(_audit(spark, sf))


def ping_lines(spark, sf):
    """Ping log lines made from the events: the mean is the event's value; errors have no summary line."""
    ev = src.events(spark, sf, "event_id", "user_id", "event_type", "ts", "value")
    v = F.col("value").cast("decimal(12,2)").cast("string")
    line = F.concat(F.lit("rtt min/avg/max/mdev = 0.10/"), v, F.lit("/999.90/1.25 ms"))
    return ev.select(
        "event_id",
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("label"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"),
        F.when(F.col("event_type") == "error", F.lit("100% packet loss")).otherwise(line).alias("ping"),
    )


def ping_samples(spark, sf):
    lines = ping_lines(spark, sf)
    parsed = lines.withColumns(
        {
            "ts": sessions.parse_timestamp(F.col("time"), sessions.PING_FORMATS),
            "latency_ms": rtt_mean(F.col("ping")),
        }
    )
    kept = parsed.filter(F.col("ts").isNotNull() & F.col("latency_ms").isNotNull())
    return kept.select("event_id", "label", sessions.whole_second(F.col("ts")).alias("second"), "latency_ms")


PINGS = src.EVENTS + """,
pings AS (
  SELECT event_id, 'host-' || user_id AS label, second, value AS latency_ms FROM ev WHERE event_type <> 'error')"""


@query("ping_parse", f"WITH {PINGS} SELECT * FROM pings")
def ping_parse(spark, sf):
    return ping_samples(spark, sf)


@query(
    "ping_mean_bins",
    f"WITH {PINGS} SELECT label, second // 10800 AS bin, round(avg(latency_ms), 6) AS mean_value FROM pings GROUP BY ALL",
)
def ping_mean_bins(spark, sf):
    out = mean_bins(ping_samples(spark, sf), ["label"], "second", "latency_ms", 10_800)
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query(
    "dense_calendar",
    f"""WITH {src.EVENTS},
    d AS (SELECT user_id, event_type, second // 86400 AS bin, CAST(sum(cents) AS BIGINT) AS cents FROM ev GROUP BY ALL),
    s AS (SELECT user_id, event_type, unnest(range(min(bin), max(bin) + 1)) AS bin FROM d GROUP BY user_id, event_type)
    SELECT s.user_id, s.event_type, s.bin, coalesce(d.cents, 0) AS cents
    FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.event_type = s.event_type AND d.bin = s.bin""",
)
def dense_calendar_query(spark, sf):
    ev = src.events(spark, sf, "user_id", "event_type", "second", "cents")
    day = F.floor(F.col("second") / 86_400).cast("long").alias("bin")
    bins = ev.groupBy("user_id", "event_type", day).agg(F.sum("cents").alias("cents"))
    return dense_calendar(bins, ["user_id", "event_type"], ["cents"])


# ---- keys ---------------------------------------------------------------------------------


@query(
    "first_k_keys",
    f"""WITH {src.PACKETS}, k AS (SELECT DISTINCT src_ip FROM packets ORDER BY src_ip LIMIT 20)
    SELECT p.src_ip, p.dst_ip, p.second, p.size FROM packets p JOIN k USING (src_ip)""",
)
def first_k_keys(spark, sf):
    p = src.packets(spark, sf).select("src_ip", "dst_ip", F.col("timestamp").cast("long").alias("second"), "size")
    return keys.first_k_keys(p, ["src_ip"], 20)


@query(
    "allowlist_semi",
    f"""WITH {src.PACKETS}
    SELECT src_ip, source_file, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM packets
    WHERE src_ip IN (SELECT '10.0.' || (s_suppkey // 16) || '.' || (s_suppkey % 16) FROM supplier WHERE s_acctbal > 0)
    GROUP BY ALL""",
)
def allowlist_semi(spark, sf):
    good = src.table(spark, sf, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 0")
    ip = F.concat(
        F.lit("10.0."), F.floor(F.col("s_suppkey") / 16).cast("string"), F.lit("."),
        F.pmod("s_suppkey", F.lit(16)).cast("string"),
    )
    p = src.packets(spark, sf).select("src_ip", "source_file", "size")
    kept = keys.allow_listed(p, good.select(ip.alias("src_ip")), ["src_ip"])
    return kept.groupBy("src_ip", "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("bytes")
    )


@query(
    "allowlist_subnet",
    f"""WITH {src.PACKET_BYTES}
    SELECT subnet, count(*) AS n FROM (
      SELECT regexp_extract(ip, '^([^.]*[.][^.]*[.][^.]*)', 1) AS subnet FROM ticks)
    WHERE subnet IN (SELECT '10.0.' || (s_suppkey // 16) FROM supplier WHERE s_acctbal > 5000) GROUP BY ALL""",
)
def allowlist_subnet(spark, sf):
    good = src.table(spark, sf, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 5000")
    allowed = good.select(F.concat(F.lit("10.0."), F.floor(F.col("s_suppkey") / 16).cast("string")).alias("subnet"))
    ticks = _ticks(spark, sf).withColumn("subnet", flows.subnet24(F.col("ip")))
    return keys.allow_listed(ticks, allowed, ["subnet"]).groupBy("subnet").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hash_shard_sizes",
    f"""WITH {src.PACKETS}
    SELECT CAST(('0x' || substr(md5('_' || src_ip || '_' || source_file), 1, 8))::BIGINT % 8 AS BIGINT) AS shard,
           count(*) AS n, count(DISTINCT src_ip) AS n_keys FROM packets GROUP BY ALL""",
)
def hash_shard_sizes(spark, sf):
    """All shards of the table, so every row is in exactly one of them."""
    from burstseries.functions.hashing import hash32

    p = src.packets(spark, sf).select("src_ip", "source_file")
    shard = F.pmod(hash32(["src_ip", "source_file"]), F.lit(8)).alias("shard")
    return p.groupBy(shard).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("n_keys"))


@query(
    "key_filters",
    f"""WITH {src.PACKETS}
    SELECT starts_with(src_ip, '10.0.') AS in_prefix, ends_with(dst_ip, '.1') AS has_suffix,
           source_file IN ('capture_O') AS listed, count(*) AS n FROM packets GROUP BY ALL""",
)
def key_filters(spark, sf):
    p = src.packets(spark, sf)
    return p.groupBy(
        keys.key_filter(F.col("src_ip"), prefix="10.0.").alias("in_prefix"),
        keys.key_filter(F.col("dst_ip"), suffix=".1").alias("has_suffix"),
        keys.key_filter(F.col("source_file"), values=["capture_O"]).alias("listed"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "composite_keys",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey || '::' || l_suppkey AS b FROM lineitem),
    r AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS row_id,
                 count(*) OVER (PARTITION BY b) AS c FROM p)
    SELECT row_id, CASE WHEN c > 1 THEN b || '::' || row_id ELSE b END AS point_id,
           l_partkey || '|' || l_suppkey AS join_key, l_partkey || '_' || l_suppkey AS example_id FROM r""",
)
def composite_keys(spark, sf):
    li = src.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li.withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey"))
    cols = ["l_partkey", "l_suppkey"]
    out = keys.unique_point_id(li, cols, "row_id")
    return out.select(
        "row_id",
        "point_id",
        keys.composite_key(cols, "|").alias("join_key"),
        keys.composite_key(cols, "_").alias("example_id"),
    )


@query(
    "lineage_fill",
    f"""WITH {WINDOWS} SELECT user_id AS ip, CAST(session_id AS VARCHAR) AS source_file, CAST(sum(sum_value) AS DOUBLE) AS total
    FROM wins GROUP BY ALL""",
)
def lineage_fill(spark, sf):
    wins = sessions.session_windows(_sessions(spark, sf), ["user_id"], 3_600)
    filled = keys.fill_lineage(wins.withColumnRenamed("user_id", "ip"))
    return filled.groupBy("ip", "source_file").agg(F.sum("sum_value").alias("total"))


@query(
    "lineage_dirs",
    """SELECT '/captures/' || event_type || '/' || user_id AS dir, count(*) AS n FROM events GROUP BY ALL""",
)
def lineage_dirs(spark, sf):
    ev = src.table(spark, sf, "events", "event_type", "user_id", "event_id")
    path = F.concat_ws("/", F.lit("/captures"), "event_type", "user_id", F.concat("event_id", F.lit(".parquet")))
    return ev.groupBy(files.parent_dir(path).alias("dir")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "multi_root_scan",
    """SELECT source_file, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (
         SELECT *, 'site_a' AS source_file FROM events UNION ALL SELECT *, 'site_b' AS source_file FROM events)
       GROUP BY ALL""",
)
def multi_root_scan(spark, sf):
    roots = {"site_a": f"{sf}/events.parquet", "site_b": f"{sf}/events.parquet"}
    both = files.scan_roots(spark, roots, ["event_type", "value"])
    return both.groupBy("source_file", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "fixture_subset",
    """SELECT event_id, user_id, event_type, (SELECT count(*) FROM events) AS source_rows
       FROM events ORDER BY event_id LIMIT 100""",
)
def fixture_subset(spark, sf):
    ev = src.table(spark, sf, "events", "event_id", "user_id", "event_type")
    return files.fixture_subset(ev, ["event_id"], 100)
