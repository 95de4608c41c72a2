"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are integer-valued; each dimension is two terms, one for its positive and one for its negative
part. Vectors are dealt into blocks that are ranges of an order in which near vectors are near (the signs of
their strongest dimensions). A block keeps its forward index (its rows of numbers) and, per term, the largest
weight in it. A query's bound for a block is the sum of its own weights times those maxima. Blocks are visited
in falling order of their bounds and scored from their forward index, until no bound reaches the k-th best
score so far.

First every query is scored inside its own block, which gives a lower limit of its k-th score. Then blocks
of queries meet groups of blocks, each pair once; a group gives at most the k best of a query, and only those
that reach the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstseries.llm.common import stored
from burstseries.llm.registry import query, table

BLOCK = 256  # vectors a block
GROUP = 64  # blocks a group
QUERIES = 512  # queries handled together

BLOCKS = "dim int, block long, ids binary, rows binary, top binary, low binary"


def usable_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v: array<long>, dim): ``floor(scale * x)``; null vectors and such with null, NaN or infinite
    components are left out. Null ids take no part either, as they cannot be ranked or named."""
    v = F.col(vector)
    bad = F.exists(
        v,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")),
    )
    df = df.filter(F.col(id_column).isNotNull() & v.isNotNull() & ~bad)
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    return df.select(F.col(id_column).cast("long").alias("vec_id"), ints.alias("v"), F.size(v).alias("dim"))


def _matrix(rows: pa.Array, dim: int) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), dim)


def _pack_block(dim: int, block: int, ids: np.ndarray, m: np.ndarray) -> tuple:
    top = m.max(axis=0) if dim else np.zeros(0)
    low = m.min(axis=0) if dim else np.zeros(0)
    return dim, block, ids.astype("<i8").tobytes(), m.astype("<f8").tobytes(), top.tobytes(), low.tobytes()


def _to_blocks(width: int):
    """Sorted rows of a partition to blocks of at most ``width`` rows of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = None
        n = 0
        held: list[tuple[int, np.ndarray, np.ndarray]] = []  # (dim, ids, matrix) not yet a full block
        count = 0

        def flush(out: list) -> None:
            nonlocal n, held, count
            if held:
                dim = held[0][0]
                out.append(_pack_block(dim, base + n, np.concatenate([h[1] for h in held]), np.vstack([h[2] for h in held])))
                n, held, count = n + 1, [], 0

        def emit(out: list) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            names = ["dim", "block", "ids", "rows", "top", "low"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            out: list = []
            if base is None:
                base = int(batch.column("part")[0].as_py()) << 32
            dims = batch.column("dim").to_numpy()
            ids = batch.column("vec_id").to_numpy()
            cuts = np.flatnonzero(np.diff(dims)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(dims)], strict=True):
                dim = int(dims[lo])
                m = _matrix(batch.column("v").slice(lo, hi - lo), dim)
                if held and held[0][0] != dim:
                    flush(out)
                at = 0
                while at < hi - lo:
                    take = min(width - count, hi - lo - at)
                    held.append((dim, ids[lo + at : lo + at + take], m[at : at + take]))
                    count, at = count + take, at + take
                    if count == width:
                        flush(out)
            if out:
                yield emit(out)
        out = []
        flush(out)
        if out:
            yield emit(out)

    return run


def build_blocks(vectors: DataFrame, width: int = BLOCK) -> DataFrame:
    """Forward-indexed blocks with their term maxima; one range shuffle."""
    strong = F.sort_array(F.transform("v", lambda x, i: F.struct(F.abs(x).alias("w"), i.alias("i"), (x > 0).alias("s"))), False)
    lead = F.transform(F.slice(strong, 1, 3), lambda x: x["i"] * 2 + x["s"].cast("int"))
    df = vectors.withColumn("__lead", lead)
    df = df.repartitionByRange("dim", "__lead", "vec_id").sortWithinPartitions("dim", "__lead", "vec_id")
    df = df.select("vec_id", "v", "dim", F.spark_partition_id().alias("part"))
    return df.mapInArrow(_to_blocks(width), BLOCKS)


def _numbers(blob: bytes, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(blob, dtype=kind)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best per row: higher score first, then smaller id."""
    if scores.shape[1] > 4 * k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        kth = np.full(scores.shape[0], -np.inf)
    out = np.full((scores.shape[0], k), -1)
    for i, (row, low) in enumerate(zip(scores, kth, strict=True)):
        at = np.flatnonzero((row >= low) & (row > -np.inf))
        at = at[np.lexsort((ids[at], -row[at]))][:k]
        out[i, : len(at)] = at
    return out


def _own_block(k: int, every: int):
    """The queries of a block with the limit that their own block gives (or none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                ids = _numbers(r["ids"], "<i8")
                m = _numbers(r["rows"]).reshape(len(ids), r["dim"])
                for i in np.flatnonzero(ids % every == 0):
                    scores = (m @ m[i])[ids != ids[i]]
                    low = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
                    for col, x in zip(out, (r["dim"], int(ids[i]), m[i].astype("<f8").tobytes(), float(low)), strict=True):
                        col.append(x)
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["dim", "query_id", "q", "low"]
            )

    return run


def search_group(queries: list[dict], blocks: list[dict], k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the best in these blocks that reach the queries' limits."""
    q = np.vstack([_numbers(x["q"]) for x in queries])
    q_ids = np.array([x["query_id"] for x in queries])
    kth = np.array([x["low"] for x in queries])
    top = np.vstack([_numbers(b["top"]) for b in blocks])
    low = np.vstack([_numbers(b["low"]) for b in blocks])
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    found: list[list[tuple[float, int]]] = [[] for _ in queries]
    decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    live = np.arange(len(queries))
    for step in range(len(blocks)):
        at = order[live, step]
        going = bounds[live, at] >= kth[live]
        live, at = live[going], at[going]
        if not len(live):
            break
        for b in np.unique(at):
            if b not in decoded:
                ids = _numbers(blocks[b]["ids"], "<i8")
                decoded[b] = ids, _numbers(blocks[b]["rows"]).reshape(len(ids), q.shape[1])
            ids, m = decoded[b]
            mine = live[at == b]
            scores = q[mine] @ m.T
            scores[q_ids[mine][:, None] == ids[None, :]] = -np.inf
            scores[scores < kth[mine][:, None]] = -np.inf
            for i, row, places in zip(mine, scores, _best(scores, ids, k), strict=True):
                got = [(-row[p], int(ids[p])) for p in places if p >= 0]
                if got:
                    found[i] = sorted(found[i] + got)[:k]
                    if len(found[i]) == k:
                        kth[i] = max(kth[i], -found[i][-1][0])
    return [(int(q_ids[i]), v, int(-s)) for i, rows in enumerate(found) for s, v in rows]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for r in batch.to_pylist() for x in search_group(r["queries"], r["blocks"], k)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, width: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The ``k`` best partners of every row whose id is divisible by ``every``, against all other rows.

    ``vectors``: see ``usable_vectors``. Vectors meet only vectors of their own dimension. Ties go to the
    smaller id; rows that bear the query's id are not its candidates; a query id that comes repeatedly with
    one vector is asked once; repeated candidate rows count each. Scores are exact below 2^53.
    """
    blocks = stored(build_blocks(vectors, width), "topk-blocks")
    queries = blocks.mapInArrow(_own_block(k, every), "dim int, query_id long, q binary, low double")
    queries = queries.groupBy("dim", "query_id", "q").agg(F.max("low").alias("low"))
    queries = stored(queries, "topk-queries")
    n_blocks, n_queries = blocks.count(), queries.count()
    n_groups, n_sets = max(1, -(-n_blocks // group)), max(1, -(-n_queries // QUERIES))
    # both sides are dealt into bounded sets; every set of queries meets every group of blocks
    b = blocks.select("dim", F.struct("ids", "rows", "top", "low").alias("b"), F.pmod(F.xxhash64("block"), F.lit(n_groups)).alias("g"))
    b = b.groupBy("dim", "g").agg(F.collect_list("b").alias("blocks"))
    q = queries.select(
        "dim", F.struct("query_id", "q", "low").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(n_sets)).alias("s")
    )
    groups = F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))
    q = q.groupBy("dim", "s").agg(F.collect_list("q").alias("queries"))
    q = q.select("dim", "queries", F.explode(groups).alias("g"))
    cells = q.join(b, ["dim", "g"])
    got = cells.select("queries", "blocks").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return got.withColumn("rank", F.row_number().over(place).cast("int")).filter(F.col("rank") <= k)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) AS d
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op3_exact_topk", OP3_SQL)
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = top_k(usable_vectors(table(spark, sf_dir, "embeddings")))
    return got.select("query_id", "rank", "vec_id", "score")
