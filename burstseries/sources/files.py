"""Readers: several roots with lineage, shard layouts, CSV with tidy headers, JSON member lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.functions.ordered import with_row


def scan_roots(spark: SparkSession, roots: Mapping[str, str] | Sequence[str], columns=None) -> DataFrame:
    """Read each root apart and tag its rows, so equal keys of two roots are not merged."""
    named = roots if isinstance(roots, Mapping) else {r: r for r in roots}
    if not named:
        raise ValueError("at least one root is needed")
    parts = []
    for tag, path in named.items():
        part = spark.read.parquet(path)
        if columns is not None:
            part = part.select(*columns)
        parts.append(part.withColumn("source_file", F.lit(tag)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _has_glob(path: str) -> bool:
    return any(c in path for c in "*?[{")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def resolve_root(spark: SparkSession, root: str, suffixes: Sequence[str] = ()) -> str:
    """``root`` itself, else the first existing ``root_<suffix>``."""
    root = root.rstrip("/")
    for path in [root, *[f"{root}_{s}" for s in suffixes]]:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {root} and its suffixes {list(suffixes)} exists")


def scan_shards(spark: SparkSession, root: str, suffixes: Sequence[str] = ()) -> DataFrame:
    """A tree of part folders (``task_0``, ``task_1``...) as one table; a glob is read as given.

    Only ``*.parquet`` files are listed, so logs and JSON notes beside them do no harm.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    if _has_glob(root):
        return reader.parquet(root)
    return reader.option("recursiveFileLookup", "true").parquet(resolve_root(spark, root, suffixes))


def scan_globs(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """Parquet files under several folders or globs, each pattern once."""
    reader = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return reader.parquet(*sorted(set(patterns)))


def tidy_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def flat_name(name: str) -> str:
    """Nested and at-sign names as plain column names (``meta.dst_ip`` -> ``meta_dst_ip``)."""
    return name.replace(".", "_").replace("@", "")


def rename_columns(df: DataFrame, rule) -> DataFrame:
    return df.toDF(*[rule(c) for c in df.columns])


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def scan_csv(spark: SparkSession, path: str, required: Sequence[str] = (), lineage: bool = True) -> DataFrame:
    """CSV with a header, all strings, names in lower_snake; ``source_file`` is the file's path."""
    df = spark.read.option("header", "true").option("recursiveFileLookup", "true").csv(path)
    files = df.select("*", F.col("_metadata.file_path").alias("source_file")) if lineage else df
    names = [tidy_name(c) for c in df.columns]
    return require(files.toDF(*names, *(["source_file"] if lineage else [])), required)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by extension (CSV types are inferred, as feature tables are numeric)."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    if path.rstrip("/").endswith(".json"):
        return spark.read.json(path)
    return spark.read.parquet(path)


def scan_member_lists(
    spark: SparkSession, paths: str | Sequence[str], id_columns: Sequence[str], one_per_file: bool = True
) -> DataFrame:
    """JSON arrays of id records, one per file or one per line; rows carry the name of their folder."""
    schema = ", ".join(f"`{c}` string" for c in id_columns)
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.schema(schema).option("multiLine", one_per_file).option("recursiveFileLookup", "true").json(paths)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return raw.select(folder.alias("member_group"), *id_columns)


def fixture_subset(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in a stated order, with the size of the table they came from."""
    size = df.agg(F.count(F.lit(1)).alias("source_rows"))
    return with_row(df.orderBy(*order).limit(n), size)
