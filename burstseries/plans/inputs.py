"""The tables the registered queries read, and the same derivations as SQL text.

``lineitem`` stands for packets (supplier and part as addresses, quantity as size, ship date as
time), ``events`` for per-entity traffic and samples, ``embeddings`` for representation vectors.
Every derived table is made from all rows of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.operators.bursts import bursts_from_series
from burstseries.operators.dense import dense_series
from burstseries.operators.features import minimal_features, to_long
from burstseries.operators.splits import make_splits

HOUR = 3_600
WEEK_MS = 7 * 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# ---- packets ------------------------------------------------------------------------------


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(
        spark, sf_dir, "lineitem",
        "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    c = F.col

    def address(prefix: str, key: str):
        return F.concat(
            F.lit(prefix), F.floor(c(key) / 16).cast("string"), F.lit("."), F.pmod(key, F.lit(16)).cast("string")
        )

    loop = (c("l_linestatus") == "F") & (c("l_linenumber") == 7)
    return li.select(
        F.when(loop, "127.0.0.1").otherwise(address("10.0.", "l_suppkey")).alias("src_ip"),
        address("10.1.", "l_partkey").alias("dst_ip"),
        F.when(c("l_linenumber") > 1, c("l_linenumber") * 1000).cast("int").alias("src_port"),
        F.when((c("l_returnflag") == "R") & (c("l_linenumber") <= 2), None)
        .when(c("l_returnflag") == "A", 443)
        .when(c("l_returnflag") == "N", 5353)
        .otherwise(8080)
        .cast("int")
        .alias("dst_port"),
        (F.unix_micros(c("l_shipdate").cast("timestamp")) / 1_000_000.0).alias("timestamp"),
        c("l_quantity").cast("int").alias("size"),
        F.concat(F.lit("capture_"), c("l_linestatus")).alias("source_file"),
    )


PACKETS = """
packets AS (
  SELECT CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN '127.0.0.1'
              ELSE '10.0.' || (l_suppkey // 16) || '.' || (l_suppkey % 16) END AS src_ip,
         '10.1.' || (l_partkey // 16) || '.' || (l_partkey % 16) AS dst_ip,
         CASE WHEN l_linenumber > 1 THEN l_linenumber * 1000 END AS src_port,
         CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN NULL
              WHEN l_returnflag = 'A' THEN 443 WHEN l_returnflag = 'N' THEN 5353 ELSE 8080 END AS dst_port,
         epoch_us(l_shipdate) // 1000000 AS second,
         CAST(l_quantity AS INTEGER) AS size,
         'capture_' || l_linestatus AS source_file
  FROM lineitem)"""

PACKET_BYTES = PACKETS + """,
ported AS (
  SELECT *, second * 10 AS window_start, least(coalesce(src_port, 0), coalesce(dst_port, 0)) AS service_port
  FROM packets WHERE NOT starts_with(src_ip, '127.') AND NOT starts_with(dst_ip, '127.')),
sized AS (
  SELECT *, CASE WHEN coalesce(dst_port, -1) <> service_port THEN size ELSE 0 END AS inb,
            CASE WHEN coalesce(dst_port, -1) = service_port THEN size ELSE 0 END AS outb
  FROM ported),
sides AS (
  SELECT window_start, src_ip AS ip, service_port, source_file, inb, outb FROM sized
  UNION ALL
  SELECT window_start, dst_ip, service_port, source_file, outb, inb FROM sized),
ticks AS (
  SELECT window_start, ip, CAST(service_port AS BIGINT) AS service_port, source_file,
         CAST(sum(inb) AS BIGINT) AS total_inbound_bytes, CAST(sum(outb) AS BIGINT) AS total_outbound_bytes
  FROM sides GROUP BY ALL)"""


# ---- events -------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    ev = ev.withColumns(
        {"ts": F.col("ts").cast("timestamp"), "cents": F.round(F.col("value") * 100).cast("long")}
    )
    ev = ev.withColumn("second", F.floor(F.unix_micros("ts") / F.lit(1_000_000)).cast("long"))
    return ev.select(*columns) if columns else ev


EVENTS = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents,
         epoch_us(ts) // 1000000 AS second
  FROM events)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents per user and hour; purchases count as outbound."""
    ev = events(spark, sf_dir, "user_id", "second", "event_type", "cents")
    out = F.col("event_type") == "purchase"
    zero = F.lit(0).cast("long")
    return ev.groupBy("user_id", F.floor(F.col("second") / HOUR).cast("long").alias("bin")).agg(
        F.sum(F.when(~out, F.col("cents")).otherwise(zero)).alias("inbound"),
        F.sum(F.when(out, F.col("cents")).otherwise(zero)).alias("outbound"),
    )


HOURLY = EVENTS + """,
hourly AS (
  SELECT user_id, second // 3600 AS bin,
         CAST(sum(CASE WHEN event_type <> 'purchase' THEN cents ELSE 0 END) AS BIGINT) AS inbound,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS BIGINT) AS outbound
  FROM ev GROUP BY ALL)"""

THRESHOLD = 1000


def series(spark: SparkSession, sf_dir: str, truncate: str = "span", item_type: str = "double") -> DataFrame:
    return dense_series(
        hourly(spark, sf_dir),
        ["user_id"],
        {"inbound": "inbound", "outbound": "outbound"},
        threshold=THRESHOLD,
        min_len=5,
        truncate=truncate,
        item_type=item_type,
    )


SERIES = HOURLY + """,
span AS (
  SELECT user_id, min(bin) AS first_bin, max(bin) AS last_bin FROM hourly GROUP BY ALL),
slots AS (SELECT user_id, first_bin, unnest(range(first_bin, last_bin + 1)) AS b FROM span),
cells AS (
  SELECT s.user_id, s.first_bin, s.b - s.first_bin AS i,
         CASE WHEN h.inbound >= 1000 THEN h.inbound ELSE 0 END AS vin,
         CASE WHEN h.outbound >= 1000 THEN h.outbound ELSE 0 END AS vout
  FROM slots s LEFT JOIN hourly h ON h.user_id = s.user_id AND h.bin = s.b),
kept AS (
  SELECT user_id, count(*) FILTER (WHERE vin > 0) AS k_in, count(*) FILTER (WHERE vout > 0) AS k_out
  FROM cells GROUP BY ALL),
series AS (
  SELECT c.*, k.k_in, k.k_out FROM cells c JOIN kept k USING (user_id) WHERE greatest(k.k_in, k.k_out) >= 5)"""


def bursts(spark: SparkSession, sf_dir: str, keep_bins: bool = False) -> DataFrame:
    return bursts_from_series(
        series(spark, sf_dir), ["user_id"], threshold=THRESHOLD, min_len=5, keep_bins=keep_bins
    )


BURSTS = SERIES + """,
active AS (
  SELECT user_id, i AS bin, CAST(vin AS BIGINT) AS bi,
         row_number() OVER w - 1 AS pos, coalesce(i - lag(i) OVER w, 0) AS ibg,
         count(*) OVER (PARTITION BY user_id) AS n_active
  FROM series WHERE vin >= 1000 WINDOW w AS (PARTITION BY user_id ORDER BY i)),
bursts AS (SELECT user_id, pos, bin, bi, ibg FROM active WHERE n_active >= 5)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_splits(bursts(spark, sf_dir), ["user_id"])


SPLITS = BURSTS + """,
lens AS (
  SELECT user_id, min(bin) AS first_bin, CAST(count(*) FILTER (WHERE bi > 0) AS INTEGER) AS _burst_count,
         CAST(count(*) AS INTEGER) AS _seq_len
  FROM bursts GROUP BY ALL),
shaped AS (
  SELECT *, CAST(trunc(_seq_len * 0.7::DOUBLE) AS INTEGER) AS context_len,
         _seq_len - CAST(trunc(_seq_len * 0.7::DOUBLE) AS INTEGER) AS forecast_len,
         CASE WHEN ('0x' || substr(md5('42_' || user_id), 1, 8))::BIGINT / 4294967296.0 < 0.7
              THEN 'train' ELSE 'test' END AS split
  FROM lens WHERE _burst_count >= 3 AND _seq_len >= 3),
splits AS (
  SELECT s.*, CAST(s.user_id AS VARCHAR) AS example_id,
         max(b.bin) FILTER (WHERE b.pos = s.context_len - 1) AS context_end_bin,
         max(b.bin) FILTER (WHERE b.pos = s.context_len) AS forecast_start_bin,
         max(b.bin) FILTER (WHERE b.pos = s._seq_len - 1) AS forecast_end_bin
  FROM shaped s JOIN bursts b USING (user_id) GROUP BY ALL)"""


# ---- vectors and features -----------------------------------------------------------------

DIMS = 64
REPR = [f"repr_dim_{i}" for i in range(DIMS)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("vector")
    )


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table of the hourly series in whole currency units, named like the vectors' ids."""
    whole = F.transform("inbound", lambda x: x / 100.0).alias("inbound")
    feats = minimal_features(series(spark, sf_dir).select("user_id", whole), ["user_id"], "inbound")
    return feats.withColumnRenamed("user_id", "vec_id")


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features joined with cluster labels."""
    labels = vectors(spark, sf_dir).select("vec_id", "cluster_id")
    feats = user_features(spark, sf_dir).select("vec_id", *FEATURES)
    return feats.join(labels, "vec_id")


FEATURE_NAMES = [
    "median", "mean", "length", "standard_deviation", "variance",
    "root_mean_square", "maximum", "minimum",
]
FEATURES = [f"value__{f}" for f in FEATURE_NAMES]


def feature_long(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    source = labelled_features(spark, sf_dir) if table is None else table
    return to_long(source, ["cluster_id", "vec_id"], FEATURES)


USER_FEATURES = SERIES + """,
dollars AS (SELECT user_id, i, vin / 100.0::DOUBLE AS v FROM series),
user_features AS (
  SELECT user_id AS vec_id, median(v) AS value__median,
         avg(v) AS value__mean, count(*)::DOUBLE AS value__length,
         stddev_pop(v) AS value__standard_deviation, var_pop(v) AS value__variance,
         sqrt(avg(v * v)) AS value__root_mean_square, max(v) AS value__maximum, min(v) AS value__minimum
  FROM dollars GROUP BY ALL)"""

FEATURE_LONG = USER_FEATURES + """,
labelled AS (
  SELECT u.*, e.label AS cluster_id FROM user_features u JOIN embeddings e ON e.vec_id = u.vec_id),
long AS (
  SELECT cluster_id, vec_id, feature, value FROM (
    UNPIVOT labelled ON COLUMNS('^value__') INTO NAME feature VALUE value)),
stats AS (
  SELECT cluster_id, feature, count(*) AS n_members, count(value) AS n, avg(value) AS mean,
         CASE WHEN count(value) >= 2 THEN var_pop(value) END AS var, var_pop(value) AS var_all
  FROM long GROUP BY ALL)"""
