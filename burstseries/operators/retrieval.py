"""Nearest-neighbour search over representation vectors: exact, inside clusters, and over probed lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstseries.functions.arrays import l2_unit, lit_array
from burstseries.functions.hashing import hash32, hash_hex
from burstseries.functions.ordered import global_row_number, join_on, with_row
from burstseries.operators.keys import unique_point_id
from burstseries.session import cut_lineage

PAD_ID = "__insufficient_neighbors__"


def split_manifest(
    df: DataFrame,
    id_columns: Sequence[str],
    row_id: str,
    label: str,
    *,
    n_eval: int | None = None,
    fraction: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """Point ids, an exact seeded train/eval split and dense train ids (eval rows get -1).

    The seeded order is a hash; its row numbers come from a histogram of hash ranges, so no task
    sees the whole table.
    """
    points = unique_point_id(df, id_columns, row_id)
    size = df.agg(F.count(F.lit(1)).alias("__n"))
    if n_eval is not None:
        wanted = F.lit(int(n_eval))
    else:
        wanted = F.greatest(
            F.lit(1), F.least(F.rint(F.col("__n") * F.lit(float(fraction))).cast("long"), F.col("__n") - 1)
        )
    too_many = F.raise_error(F.lit("n_eval must be under the number of rows")).cast("long")
    size = size.select("__n", F.when(wanted < F.col("__n"), wanted).otherwise(too_many).alias("__want"))
    ranked = global_row_number(points.withColumn("__h", hash_hex([row_id], seed)), "__h", [row_id], "__rn")
    return with_row(ranked, size).select(
        "point_id",
        *id_columns,
        row_id,
        F.when(F.col("__rn") <= F.col("__want"), F.lit(-1).cast("long"))
        .otherwise(F.col("__rn") - F.col("__want") - 1)
        .alias("train_id"),
        F.col(label).cast("int").alias("cluster_id"),
        F.when(F.col("__rn") <= F.col("__want"), "eval").otherwise("train").alias("split"),
    )


def manifest_from_split(df: DataFrame, given: DataFrame) -> DataFrame:
    """Rows that a given ``(point_id, split)`` table names, with its side."""
    return join_on(df, given.select("point_id", "split"), ["point_id"])


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, l2_unit(vector))


BROADCAST_BYTES = 64 * 1024 * 1024
CELL_BYTES = 16 * 1024 * 1024  # vectors of one side of a cell


def _pick(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores, ties to the smaller name; the k-th score bounds the sort."""
    near = np.arange(len(score))
    if k * 4 < len(score):
        near = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
    order = np.lexsort((names[near], -score[near]))
    return near[order[:k]]


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def _scan_top_k(
    queries: DataFrame, base: DataFrame, k: int, group: list[str], query_id: str, base_id: str, vector: str, schema
) -> DataFrame:
    """Few queries: they go to every task and the base table is scanned where it lies, unshuffled.

    A task keeps ``k`` candidates per query of its own rows and emits them at its end.
    """
    known = queries.toPandas()
    table = {
        key: (part[query_id].to_numpy(), _matrix(part[vector])) for key, part in known.groupby(group, sort=False)
    }
    sent = base.sparkSession.sparkContext.broadcast(table)
    columns = [f.name for f in schema]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for frame in frames:
            for key, part in frame.groupby(group, sort=False):
                if key not in sent.value:
                    continue
                _, left = sent.value[key]
                names, right = part[base_id].to_numpy(), _matrix(part[vector])
                old = kept.get(key) or [(names[:0], np.empty(0))] * len(left)
                new = []
                for start in range(0, len(left), 256):
                    for at, row in enumerate(left[start : start + 256] @ right.T, start):
                        pick = _pick(row, names, k)
                        ids = np.concatenate([old[at][0], names[pick]])
                        score = np.concatenate([old[at][1], row[pick]])
                        best = _pick(score, ids, k)
                        new.append((ids[best], score[best]))
                kept[key] = new
        for key, rows in kept.items():
            counts = [len(ids) for ids, _ in rows]
            yield pd.DataFrame(
                {
                    **{g: key[i] for i, g in enumerate(group)},
                    query_id: np.repeat(sent.value[key][0], counts),
                    base_id: np.concatenate([ids for ids, _ in rows]),
                    "score": np.concatenate([score for _, score in rows]),
                }
            )[columns]

    return base.select(*group, base_id, vector).mapInPandas(scan, schema)


def _cell_top_k(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    group: list[str],
    query_id: str,
    base_id: str,
    vector: str,
    schema,
    block_rows: int,
) -> DataFrame:
    """Many queries: both sides are cut into cells inside each group and every pair of them is one task's work.

    A cell holds as many blocks of ``block_rows`` rows as ``CELL_BYTES`` have room for, at least one: every row is
    sent once per cell of the other side, so small blocks must not multiply what is shuffled.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        fit = F.floor(F.lit(CELL_BYTES / 8) / F.greatest(F.max(F.size(vector)), F.lit(1)) / block_rows)
        rows = F.greatest(fit, F.lit(1)) * block_rows
        return df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    sizes = join_on(blocks(queries, "__nq"), blocks(base, "__nb"), group)
    own_q = F.pmod(hash32([query_id], "q"), F.col("__nq")).cast("int")
    own_b = F.pmod(hash32([base_id], "b"), F.col("__nb")).cast("int")
    left = join_on(queries, sizes, group).select(
        *group,
        query_id,
        vector,
        own_q.alias("__qb"),
        F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)).alias("__bb"),
    )
    right = join_on(base, sizes, group).select(
        *group,
        base_id,
        vector,
        F.explode(F.sequence(F.lit(0), F.col("__nq") - 1)).alias("__qb"),
        own_b.alias("__bb"),
    )
    cell = [*group, "__qb", "__bb"]
    columns = [f.name for f in schema]

    def best(key, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({c: [] for c in columns})
        names, right_m, left_m = b[base_id].to_numpy(), _matrix(b[vector]), _matrix(q[vector])
        out = []
        for start in range(0, len(q), 64):
            for row in left_m[start : start + 64] @ right_m.T:
                pick = _pick(row, names, k)
                out.append((names[pick], row[pick]))
        return pd.DataFrame(
            {
                **{g: key[i] for i, g in enumerate(group)},
                query_id: np.repeat(q[query_id].to_numpy(), [len(o[0]) for o in out]),
                base_id: np.concatenate([o[0] for o in out]),
                "score": np.concatenate([o[1] for o in out]),
            }
        )[columns]

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(best, schema)


def block_top_k(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    *,
    group: Sequence[str] = (),
    query_id: str = "query_id",
    base_id: str = "base_id",
    vector: str = "vector",
    block_rows: int = 20_000,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The ``k`` base rows of largest inner product per query (and group), as ``group, query_id,
    base_id, score, rank``; ties go to the smaller base id.

    The size of the query side is measured first. Up to ``broadcast_bytes`` the queries are sent to
    the base table's tasks and nothing of it is shuffled; beyond that both sides are cut into block
    cells. Either way a task returns at most ``k`` rows per query, whatever share of the base rows a
    group holds, and the survivors are ranked per query.
    """
    grouped = list(group)
    cols = grouped or ["__g"]
    if not grouped:
        queries, base = queries.withColumn("__g", F.lit(0)), base.withColumn("__g", F.lit(0))
    # fresh column identities: both sides may come from one table
    queries = queries.select(*[F.col(c).alias(c) for c in (*cols, query_id, vector)])
    base = base.select(*[F.col(c).alias(c) for c in (*cols, base_id, vector)])
    schema = T.StructType(
        [
            *[queries.schema[g] for g in cols],
            queries.schema[query_id],
            base.schema[base_id],
            T.StructField("score", T.DoubleType()),
        ]
    )
    if _bytes(queries, vector) <= broadcast_bytes:
        found = _scan_top_k(queries, base, k, cols, query_id, base_id, vector, schema)
    else:
        found = _cell_top_k(queries, base, k, cols, query_id, base_id, vector, schema, block_rows)
    w = Window.partitionBy(*cols, query_id).orderBy(F.col("score").desc(), base_id)
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked if grouped else ranked.drop("__g")


def exact_search(queries: DataFrame, base: DataFrame, k: int, **kw) -> DataFrame:
    """Exact cosine top-k of rows that have been scaled to length 1."""
    return block_top_k(queries, base, k, **kw)


def cluster_search(queries: DataFrame, base: DataFrame, k: int, cluster: str = "cluster_id", **kw) -> DataFrame:
    """Exact top-k among the base rows of the query's own cluster."""
    return block_top_k(queries, base, k, group=[cluster], **kw)


# ---- inverted lists -----------------------------------------------------------------------


def train_lists(base: DataFrame, n_lists: int, vector: str = "vector", seed: int = 42, max_iter: int = 25) -> DataFrame:
    """``(list_id, vector)`` coarse centres of the base rows; no more lists than rows."""
    data = cut_lineage(base.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features")), "train")
    n = min(n_lists, data.count())
    spark = base.sparkSession
    schema = "list_id int, vector array<double>"
    if n < 2:
        mean = base.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
        packed = F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda c: c["m"])
        return mean.agg(F.lit(0).alias("list_id"), packed.alias("vector"))
    model = KMeans(k=n, seed=seed, maxIter=max_iter, initSteps=2).fit(data)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], schema)


def _bytes(df: DataFrame, vector: str) -> int:
    return df.agg(F.sum(F.size(vector) * 8 + 64)).first()[0] or 0


def with_nearest_lists(
    rows: DataFrame,
    lists: DataFrame,
    n: int,
    *,
    row_id: str,
    vector: str = "vector",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every row once per each of its ``n`` nearest lists, with ``list_id`` and ``probe_rank``.

    A centre table of measured small size goes to every task, so the rows stay where they are. A
    larger one is searched in block cells and joined back.
    """
    if _bytes(lists, "vector") > broadcast_bytes:
        named = lists.select("list_id", F.col("vector").alias(vector))
        found = block_top_k(rows, named, n, query_id=row_id, base_id="list_id", vector=vector)
        return join_on(rows, found.select(row_id, "list_id", F.col("rank").alias("probe_rank")), [row_id])
    known = lists.orderBy("list_id").toPandas()
    sent = rows.sparkSession.sparkContext.broadcast((known["list_id"].to_numpy(), _matrix(known["vector"])))
    schema = T.StructType(
        [*rows.schema, lists.schema["list_id"], T.StructField("probe_rank", T.IntegerType())]
    )

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, centers = sent.value
        top = min(n, len(names))
        for frame in frames:
            if frame.empty:
                continue
            score = _matrix(frame[vector]) @ centers.T
            if top == 1:
                picks = score.argmax(axis=1)
            else:
                picks = np.concatenate([_pick(row, names, top) for row in score])
            out = frame.loc[frame.index.repeat(top)]
            yield out.assign(list_id=names[picks], probe_rank=np.tile(np.arange(1, top + 1), len(frame)).astype("int32"))

    return rows.mapInPandas(scan, schema)


def assign_lists(base: DataFrame, lists: DataFrame, base_id: str = "base_id", vector: str = "vector") -> DataFrame:
    """Base rows with the list of the largest inner product. Write it with ``write_index``."""
    return with_nearest_lists(base, lists, 1, row_id=base_id, vector=vector).drop("probe_rank")


def write_index(assigned: DataFrame, path: str) -> None:
    """Store rows partitioned by list, so a search reads the probed lists only."""
    assigned.write.mode("overwrite").option("compression", "zstd").partitionBy("list_id").parquet(path)


def list_search(
    queries: DataFrame,
    assigned: DataFrame,
    lists: DataFrame,
    k: int,
    n_probe: int,
    *,
    cluster: str | None = None,
    query_id: str = "query_id",
    base_id: str = "base_id",
    vector: str = "vector",
    **kw,
) -> DataFrame:
    """Top-k per query over its ``n_probe`` nearest lists, with the probe rank each hit came from.

    ``cluster`` restricts hits to base rows of the query's cluster.
    """
    extra = [cluster] if cluster else []
    spread = with_nearest_lists(
        queries.select(query_id, vector, *extra), lists, n_probe, row_id=query_id, vector=vector
    )
    hits = block_top_k(
        spread,
        assigned,
        k,
        group=["list_id", *extra],
        query_id=query_id,
        base_id=base_id,
        vector=vector,
        **kw,
    )
    placed = join_on(hits.drop("rank"), spread.select(query_id, "list_id", "probe_rank"), [query_id, "list_id"])
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), base_id)
    return placed.withColumn("rank", F.row_number().over(w))


def search_lists(queries: DataFrame, assigned: DataFrame, lists: DataFrame, k: int, n_probe: int, **kw) -> DataFrame:
    return list_search(queries, assigned, lists, k, n_probe, **kw).filter(F.col("rank") <= k)


def _positive_distinct(values: Sequence[int]) -> list[int]:
    return [v for v in dict.fromkeys(int(x) for x in values) if v >= 1]


def probe_grid(
    queries: DataFrame,
    assigned: DataFrame,
    lists: DataFrame,
    probes: Sequence[int],
    *,
    query_id: str = "query_id",
    base_id: str = "base_id",
    cluster_of: str = "cluster_id",
    **kw,
) -> DataFrame:
    """Best neighbour per query and probe count, from a single search at the largest count.

    ``(query_id, n_probe, neighbor_id, neighbor_cluster)``; -1 where nothing was found.
    """
    probes = _positive_distinct(probes)
    hits = list_search(queries, assigned, lists, 1, max(probes), query_id=query_id, base_id=base_id, **kw)
    grid = lit_array(probes, "int")
    each = hits.select(
        query_id,
        base_id,
        "score",
        F.explode(F.filter(grid, lambda p: p >= F.col("probe_rank"))).alias("n_probe"),
    )
    best = each.groupBy(query_id, "n_probe").agg(
        F.max_by(F.struct(base_id), F.struct(F.col("score"), -F.col(base_id))).alias("__b")
    ).select(query_id, "n_probe", F.col(f"__b.{base_id}").alias(base_id))
    named = join_on(best, assigned.select(base_id, F.col(cluster_of).alias("neighbor_cluster")), [base_id])
    every = queries.select(query_id, F.explode(grid).alias("n_probe"))
    out = join_on(every, named, [query_id, "n_probe"], "left")
    return out.select(
        query_id,
        "n_probe",
        F.coalesce(base_id, F.lit(-1).cast("long")).alias("neighbor_id"),
        F.coalesce("neighbor_cluster", F.lit(-1)).alias("neighbor_cluster"),
    )


def train_id_map(manifest: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Train ids with their cluster and point, as the grid's neighbours are named."""
    return manifest.filter(F.col("split") == "train").select("train_id", "cluster_id", "point_id", *columns)


def stack_models(tables: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Result tables of several models in one, sorted by model and ``order``."""
    parts = [df.withColumn("model", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("model", *order)


def grid_wide(grid: DataFrame, probes: Sequence[int], query_id: str = "query_id") -> DataFrame:
    """One row per query with neighbour and cluster columns per probe count."""
    aggs = []
    for p in _positive_distinct(probes):
        here = F.col("n_probe") == p
        aggs.append(F.max(F.when(here, F.col("neighbor_id"))).alias(f"neighbor_id_nprobe_{p}"))
        aggs.append(F.max(F.when(here, F.col("neighbor_cluster"))).alias(f"retrieved_cluster_nprobe_{p}"))
    return grid.groupBy(query_id).agg(*aggs)


def probe_changes(grid: DataFrame, reference: int, query_id: str = "query_id") -> DataFrame:
    """Per probe count: queries whose neighbour or cluster differs from the reference count's."""
    ref = grid.filter(F.col("n_probe") == reference).select(
        query_id, F.col("neighbor_id").alias("__n"), F.col("neighbor_cluster").alias("__c")
    )
    joined = join_on(grid, ref, [query_id])
    cluster = (F.col("neighbor_cluster") != F.col("__c")).cast("long")
    neighbor = (F.col("neighbor_id") != F.col("__n")).cast("long")
    out = joined.groupBy("n_probe").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.sum(cluster).alias("cluster_changed"),
        F.sum(neighbor).alias("neighbor_changed"),
    )
    pct = {
        f"{c}_pct": F.round(100.0 * F.col(c) / F.col("total_queries"), 4)
        for c in ("cluster_changed", "neighbor_changed")
    }
    return out.withColumns({"n_probe_ref": F.lit(reference), **pct})


def compare_probes(grid: DataFrame, a: int, b: int, query_id: str = "query_id") -> DataFrame:
    """Per query the hits at two probe counts and whether cluster or neighbour changed."""
    wide = grid_wide(grid, [a, b], query_id)
    n_a, n_b = F.col(f"neighbor_id_nprobe_{a}"), F.col(f"neighbor_id_nprobe_{b}")
    c_a, c_b = F.col(f"retrieved_cluster_nprobe_{a}"), F.col(f"retrieved_cluster_nprobe_{b}")
    return wide.withColumns({"cluster_changed": c_a != c_b, "neighbor_changed": n_a != n_b})


# ---- distance rows ------------------------------------------------------------------------


def padded_neighbors(queries: DataFrame, hits: DataFrame, k: int, query_id: str, base_id: str) -> DataFrame:
    """Exactly ``k`` rows per query; missing ranks have no neighbour. Adds the number found."""
    counts = hits.groupBy(query_id).agg(F.count(F.lit(1)).alias("neighbor_count"))
    every = queries.select(query_id, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    joined = join_on(every, hits.select(query_id, "rank", base_id), [query_id, "rank"], "left")
    return join_on(joined, counts, [query_id], "left").withColumn(
        "neighbor_count", F.coalesce("neighbor_count", F.lit(0).cast("long"))
    )


def sanity_report(distances: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, finite distances per kind, missing series and padded slots."""
    finite = [
        F.count(F.when(F.col(c).isNotNull() & ~F.isnan(c), True)).alias(f"finite_{c}") for c in columns
    ]
    has_n = F.col("neighbor_id") != PAD_ID
    return distances.agg(
        F.count_distinct("test_point_id").alias("n_queries"),
        F.count(F.lit(1)).alias("n_rows"),
        *finite,
        F.count_distinct(F.when(~F.col("eval_found"), F.col("test_point_id"))).alias("missing_eval_series"),
        F.count(F.when(has_n & F.col("eval_found") & ~F.col("neighbor_found"), True)).alias("missing_neighbor_series"),
        F.count(F.when(~has_n, True)).alias("padded_slots"),
    )
