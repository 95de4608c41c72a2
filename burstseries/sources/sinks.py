"""Writers: zstd Parquet per product, CSV/JSON results, one folder per cluster."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_products(products: Mapping[str, DataFrame], root: str) -> None:
    """Each named table below ``root`` as zstd Parquet, replacing what was there."""
    for name, df in products.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root.rstrip('/')}/{name}")


def safe_id(column: str):
    """Characters that do not belong in a folder name become underscores."""
    return F.regexp_replace(F.col(column).cast("string"), r"[^A-Za-z0-9._-]", "_")


def write_per_cluster(df: DataFrame, path: str, cluster: str, fmt: str = "csv") -> None:
    """One folder per cluster, with as many files as its size asks for.

    Rows are brought together by cluster, so not every task opens a file in every folder. The rebalance hint lets
    adaptive execution split a large cluster into parts of the advisory partition size, each with a writer of
    its own, and put small clusters into one task.
    """
    out = df.withColumn("cluster", safe_id(cluster)).hint("rebalance", F.col("cluster"))
    writer = out.write.mode("overwrite").partitionBy("cluster")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A result table as CSV (with header) or JSON lines."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
