"""Queries that write a given table in some layout to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstseries.operators import gram as G
from burstseries.plans import inputs as src
from burstseries.plans.registry import query
from burstseries.session import fresh_path
from burstseries.sources import files, sinks

TASKS = 4


def _order_shards(spark, sf) -> str:
    """Orders in folders ``task_0``, ``task_1``... by key, with a log file beside them."""
    root = fresh_path(spark, "order") + "_shards"
    orders = src.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    for i in range(TASKS):
        orders.filter(F.pmod("o_orderkey", F.lit(TASKS)) == i).write.parquet(f"{root}/task_{i}")
    spark.range(1).select(F.lit("done").alias("value")).write.text(f"{root}/log")
    return root


ORDERS_BY_STATUS = """SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
    CAST(sum(CAST(round(CAST(o_totalprice AS DOUBLE) * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders"""


def _by_status(df):
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"),
        F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"),
    )


@query("shard_layout_scan", f"{ORDERS_BY_STATUS} GROUP BY ALL")
def shard_layout_scan(spark, sf):
    """All part folders of a root as one table, found under the root's suffixed name; other files do no harm."""
    root = _order_shards(spark, sf)
    return _by_status(files.scan_shards(spark, root.removesuffix("_shards"), ["missing", "shards"]))


@query("glob_scan", f"{ORDERS_BY_STATUS} WHERE o_orderkey % 4 IN (1, 3) GROUP BY ALL")
def glob_scan(spark, sf):
    """Two of the part folders by their patterns, one of them named twice."""
    root = _order_shards(spark, sf)
    return _by_status(files.scan_globs(spark, [f"{root}/task_[1]", f"{root}/task_3", f"{root}/task_3"]))


@query(
    "csv_scan",
    """SELECT CAST(c_nationkey AS VARCHAR) AS nation_key, count(*) AS n, CAST(sum(CAST(round(CAST(c_acctbal AS DOUBLE) * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM customer GROUP BY ALL""",
)
def csv_scan(spark, sf):
    """CSV with untidy headers: names in lower_snake, every value a string."""
    path = fresh_path(spark, "customer-csv")
    cents = F.round(F.col("c_acctbal").cast("double") * 100).cast("long")
    customers = src.table(spark, sf, "customer").select(F.col("c_custkey").alias(" Cust Key"), F.col("c_nationkey").alias("Nation Key "), cents.alias("Balance"))
    sinks.write_result(customers, path)
    read = files.scan_csv(spark, path, ["cust_key", "nation_key", "balance"])
    return read.groupBy("nation_key").agg(F.countDistinct("cust_key").alias("n"), F.sum(F.col("balance").cast("long")).alias("cents"))


@query(
    "scan_by_extension",
    """SELECT f AS kind, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM supplier, (SELECT unnest(['csv', 'json', 'parquet']) AS f) GROUP BY f""",
)
def scan_by_extension(spark, sf):
    """The same table as CSV, JSON lines and Parquet, each read by its name."""
    root, out = fresh_path(spark, "suppliers"), None
    suppliers = src.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    for kind in ("csv", "json", "parquet"):
        sinks.write_result(suppliers, f"{root}.{kind}", kind)
        part = files.scan_table(spark, f"{root}.{kind}").select(F.lit(kind).alias("kind"), F.col("s_suppkey").cast("long").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query(
    "parquet_products",
    """SELECT 'nation' AS product, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation
    UNION ALL SELECT 'region', count(*), CAST(sum(r_regionkey) AS BIGINT) FROM region
    UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part""",
)
def parquet_products(spark, sf):
    """Several named tables below one root, written twice: the second run replaces the first."""
    root, out = fresh_path(spark, "products"), None
    keys = {"nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey"}
    tables = {t: src.table(spark, sf, t).select(F.col(k).cast("long").alias("key")) for t, k in keys.items()}
    for _ in range(2):
        sinks.write_products(tables, root)
    for t in tables:
        part = spark.read.parquet(f"{root}/{t}").select(F.lit(t).alias("product"), "key")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query(
    "per_cluster_sink",
    """SELECT regexp_replace(l_linestatus || '/' || l_returnflag, '[^A-Za-z0-9._-]', '_', 'g') AS cluster, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers
    FROM lineitem GROUP BY ALL""",
)
def per_cluster_sink(spark, sf):
    """One folder per cluster, named by its safe id, read back by folder."""
    path = fresh_path(spark, "clusters")
    pair = F.concat_ws("/", "l_linestatus", "l_returnflag").alias("cluster_id")
    sinks.write_per_cluster(src.table(spark, sf, "lineitem").select(pair, "l_orderkey", "l_linenumber"), path, "cluster_id")
    read = spark.read.option("header", "true").csv(path)
    return read.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("numbers"))


@query(
    "complete_row_rules",
    """SELECT label, count(*) FILTER (WHERE vec_id % 5 <> 0) AS n_some, count(*) FILTER (WHERE vec_id % 5 <> 0 AND vec_id % 3 <> 0) AS n_complete
    FROM embeddings GROUP BY label""",
)
def complete_row_rules(spark, sf):
    """Rows without any number go first, rows that lack one go per metric; every fifth lacks all, every third one."""
    v = src.table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    names = [f"x{i}" for i in range(4)]
    gone = [(F.col("vec_id") % 5 == 0) | (F.lit(i == 2) & (F.col("vec_id") % 3 == 0)) for i in range(4)]
    cols = [F.when(~g, F.get("embedding", F.lit(i)).cast("double")).otherwise(F.lit(None if i % 2 else float("nan"))).alias(c) for i, (c, g) in enumerate(zip(names, gone, strict=True))]
    wide = v.select("label", *cols)
    some = G.rows_with_a_number(wide, names)
    kept = some.withColumn("complete", F.lit(0)).unionByName(G.complete_rows(some, names).withColumn("complete", F.lit(1)))
    return kept.groupBy("label").agg(F.count_if(F.col("complete") == 0).alias("n_some"), F.count_if(F.col("complete") == 1).alias("n_complete"))
