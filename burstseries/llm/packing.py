"""Best-fit packing of token sequences: large-item matching on a histogram of lengths.

Only the number of pieces of each length matters for the plan, so the plan is made from a histogram of at
most ``capacity`` counts, whatever the number of documents, and pieces find their place by their rank among
pieces of their length.

- Pieces above a third of the capacity come at most two to a sequence: from the longest down, each is matched
  with the longest other that still fits.
- The rest, from the longest down, go to the smallest gap that takes them; a gap takes as many as fit.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstseries.llm.bpe import byte_bpe, default_vocabulary
from burstseries.llm.common import stored
from burstseries.llm.registry import query, table

CAPACITY = 1024
END = 2


def cut_points(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    head = n % capacity
    if head:
        yield 0, head
    for s in range(head, n, capacity):
        yield s, capacity


def _encode(vocabulary: tuple[str, str], capacity: int, end: int, id_column: str, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*vocabulary)
        for batch in batches:
            ids, texts = batch.column(id_column), batch.column("text")
            for lo in range(0, batch.num_rows, 500):
                row, piece, start, length, crc, tokens = [], [], [], [], [], []
                for i in range(lo, min(lo + 500, batch.num_rows)):
                    got = np.append(bpe.ids(texts[i].as_py() or ""), np.uint32(end)).astype("<u4")
                    for k, (s, n) in enumerate(cut_points(len(got), capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        part = got[s : s + n]
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            tokens.append(part.astype(np.int32))
                cols = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
                cols += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = [id_column, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def token_pieces(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    end: int = END,
    vocabulary: tuple[str, str] | None = None,
    id_column: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document's ids (null text: only the end id); narrow. ``with_ids`` adds the ids."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    run = _encode(vocabulary or default_vocabulary(), capacity, end, id_column, with_ids)
    return docs.select(id_column, "text").mapInArrow(run, schema)


def packing_plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, end rank, first sequence, per sequence, offset) of a packing.

    Rank r of a segment goes to sequence ``first + (r - r0) // per`` at ``offset + length * ((r - r0) % per)``.
    Work and size depend on the capacity, not on the counts.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, number of sequences)
    keys: list[int] = []
    made = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(keys, gap)
            gaps[gap].append((first, n))

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        plan.append((length, rank[length], rank[length] + n, first, per, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:
            b = large[at - 1] if at >= 1 else None
        if b is None:
            n = left[a]
            put(a, n, made, 1, 0)
            leave(capacity - a, made, n)
        elif b == a:
            n = left[a] // 2
            put(a, 2 * n, made, 2, 0)
            leave(capacity - 2 * a, made, n)
        else:
            n = min(left[a], left[b])
            put(a, n, made, 1, 0)
            put(b, n, made, 1, a)
            leave(capacity - a - b, made, n)
        made += n
        large = [x for x in large if left[x] > 0]

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s] > 0:
            at = bisect.bisect_left(keys, s)
            if at == len(keys):
                per = capacity // s
                n = -(-left[s] // per)
                leave(capacity, made, n)
                made += n
                continue
            gap = keys[at]
            first, n = gaps[gap].pop()
            per = gap // s
            whole = min(n, left[s] // per)
            if whole:
                put(s, whole * per, first, per, capacity - gap)
                leave(gap - per * s, first, whole)
                first, n = first + whole, n - whole
            if n and left[s]:
                some = left[s]  # fewer than one sequence takes
                put(s, some, first, some, capacity - gap)
                leave(gap - some * s, first, 1)
                first, n = first + 1, n - 1
            if n:
                gaps[gap].append((first, n))
            elif not gaps[gap]:
                del gaps[gap]
                keys.remove(gap)
    return plan


def ranked(pieces: DataFrame, by: str, order: list[str], rows: int, width: int = 2000) -> DataFrame:
    """``rank`` from 0 among the rows with one value of ``by``, without a task that sees them all.

    Rows are dealt into hash buckets of about ``width`` rows; a running sum over the buckets' sizes gives
    each bucket its first rank.
    """
    n = max(1, -(-rows // width))
    df = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = df.groupBy(by, "__bucket").agg(F.count("*").alias("__n"))
    firsts = firsts.select(by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy(by, "__bucket").orderBy(*order)) - 1
    out = df.withColumn("__inside", inside).join(firsts, [by, "__bucket"])
    return out.withColumn("rank", F.col("__first") + F.col("__inside")).drop("__bucket", "__first", "__inside")


def place(pieces: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` must be stored: it is read three times."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = packing_plan(counts, capacity)
    schema = "p_length long, r0 long, r1 long, first long, per long, at long"
    # at most a few segments for each of `capacity` lengths
    seg = F.broadcast(spark.createDataFrame(plan, schema).coalesce(1))
    rows = ranked(pieces, "length", [id_column, "piece", "ids_crc32"], sum(counts.values()))
    r = F.col("rank")
    out = rows.join(seg, (rows["length"] == seg["p_length"]) & (r >= seg["r0"]) & (r < seg["r1"]))
    k = r - F.col("r0")
    return out.select(
        *pieces.columns,
        (F.col("first") + F.floor(k / F.col("per")).cast("long")).alias("sequence_id"),
        (F.col("at") + F.col("length") * (k % F.col("per"))).alias("offset"),
    )


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end: int = END, vocabulary=None) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Null and empty texts are the end id alone; repeated rows are packed as often as they come; null ids
    stay null; an empty table gives no rows.
    """
    pieces = token_pieces(docs, capacity=capacity, end=end, vocabulary=vocabulary)
    return place(stored(pieces, "pack-pieces"), capacity)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
