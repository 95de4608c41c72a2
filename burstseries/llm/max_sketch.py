"""Exact ranked lexical search with hashed max-sketches.

1. One pass counts documents, terms and, for the terms of the queries, the documents that hold them.
2. A second pass folds each document's term impacts into a sketch: a row of buckets, as wide as a multiple of
   its number of different terms, where each bucket has the largest impact of the terms hashed to it. A query
   looks up all its terms in the sketches of a block of documents at once; weights times the buckets found add up
   to an upper bound of its score, as a bucket is never below the impact of a term that is there.
3. Documents of a block are rescored exactly in falling order of their bounds, until a bound is below the k-th best
   score this task has for the query. A bound equal to it is rescored too, as a smaller doc_id may win.

At most k documents per query leave a task; they are ranked in two steps. Queries are taken in blocks of bounded
size, each with its own two passes, so what is sent to the tasks does not grow with the table of queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstseries.llm.common import _LOWER, prefix_sums, range_hashes, text_pieces
from burstseries.llm.registry import query, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPREAD = 16  # buckets of a sketch per different term, before rounding up to a power of two
LOOKUPS = 1 << 21  # lookups made at once
BLOCK_BYTES = 4 << 20  # query text of one block
SALTS = 32

_SOLID = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _SOLID[_lo : _hi + 1] = True


def term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every term of texts laid end to end, row ``i`` from ``offs[i]`` on; letters A-Z lowered."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    solid = _SOLID[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.append(False, solid[:-1])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.append(solid[1:], False))) + 1
    row = np.searchsorted(offs, starts, side="right") - 1
    return range_hashes(prefix_sums(_LOWER[data]), starts, ends), row


def _hash_of(term: str) -> int:
    data = _LOWER[np.frombuffer(term.encode(), dtype=np.uint8)]
    return int(range_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


def _lowered(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


class Queries:
    """A block of queries: their ids, and all their terms end to end as places in the sorted distinct hashes."""

    def __init__(self, rows: list[tuple[int | None, list[str]]]):
        rows = [(i, sorted(set(t))) for i, t in rows if t]
        self.ids = [i for i, _ in rows]
        named = {t: _hash_of(t) for _, terms in rows for t in terms}
        self.hashes = np.array(sorted(set(named.values())), dtype=np.uint64)
        self.first = np.cumsum([0, *[len(t) for _, t in rows]])[:-1]
        flat = np.array([named[t] for _, terms in rows for t in terms], dtype=np.uint64)
        self.term = np.searchsorted(self.hashes, flat)
        self.seen = np.zeros(1 << 20, dtype=bool)  # by the top 20 bits, to pass over most terms of a text
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``hashes``, its place) for those that are terms of the queries."""
        at = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.hashes, hashes[at])
        place[place == len(self.hashes)] = 0
        hit = self.hashes[place] == hashes[at]
        return at[hit], place[hit]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        df, documents, terms = np.zeros(len(queries.hashes), dtype=np.int64), 0, 0
        for batch in batches:
            for piece in text_pieces(batch):
                h, row = term_hashes(piece.data, piece.offs)
                terms += len(h)
                documents += len(np.unique(row))
                at, place = queries.places(h)
                both = np.unique(row[at] * len(df) + place)
                df += np.bincount(both % len(df), minlength=len(df))
        at = np.flatnonzero(df)
        cols = [np.append([-1, -2], at), np.append([documents, terms], df[at])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["what", "n"])

    return run


class Sketches:
    """Forward indexes and max-sketches of the documents of a piece."""

    def __init__(self, h: np.ndarray, row: np.ndarray, rows: int, documents: int, terms: int):
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        self.hashes, own = h[at], row[at]
        n = np.bincount(row, minlength=rows).tolist()
        m = np.array([10 + (90 * x * documents) // terms for x in n], dtype=np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[own])
        self.first = np.searchsorted(own, np.arange(rows + 1))
        width = np.array([1 << (SPREAD * max(int(k), 1) - 1).bit_length() for k in np.diff(self.first)], dtype=np.int64)
        self.mask, self.base = (width - 1).astype(np.uint64), np.cumsum(width) - width
        self.buckets = np.zeros(int(width.sum()), dtype=np.int64)
        place = self.base[own] + (self.hashes & self.mask[own]).astype(np.int64)
        rising = np.argsort(self.impact, kind="stable")  # of equal places the last one written, the largest, stays
        self.buckets[place[rising]] = self.impact[rising]

    def bounds(self, queries: Queries, weights: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Upper bounds of all queries (columns) for documents ``lo`` to ``hi``."""
        place = (queries.hashes[None, :] & self.mask[lo:hi, None]).astype(np.int64) + self.base[lo:hi, None]
        found = self.buckets[place] * weights
        return np.add.reduceat(found[:, queries.term], queries.first, axis=1)

    def score(self, doc: int, terms: np.ndarray, queries: Queries, weights: np.ndarray) -> int:
        own = self.hashes[self.first[doc] : self.first[doc + 1]]
        want = queries.hashes[terms]
        at = np.searchsorted(own, want)
        at[at == len(own)] = 0
        hit = own[at] == want
        return int((self.impact[self.first[doc] + at[hit]] * weights[terms[hit]]).sum())


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, terms = shared.value
        spans = np.append(queries.first, len(queries.term))
        best: list[list[tuple[int, int]]] = [[] for _ in queries.ids]  # heaps of (score, -doc_id)
        limit = np.ones(len(queries.ids), dtype=np.int64)  # scores of 0 are not wanted
        for batch in batches:
            for piece in text_pieces(batch):
                h, row = term_hashes(piece.data, piece.offs)
                if not len(h):
                    continue
                index = Sketches(h, row, piece.rows, documents, terms)
                ids = piece.column("doc_id").to_pylist()
                step = max(1, LOOKUPS // len(queries.term))
                for lo in range(0, piece.rows, step):
                    bound = index.bounds(queries, weights, lo, min(lo + step, piece.rows))
                    for q in np.flatnonzero(bound.max(axis=0) >= limit):
                        col, heap, mine = bound[:, q], best[q], queries.term[spans[q] : spans[q + 1]]
                        may = np.flatnonzero(col >= limit[q])
                        for d in may[np.argsort(-col[may], kind="stable")]:
                            if col[d] < limit[q]:
                                break
                            doc = ids[lo + d]
                            score = index.score(lo + int(d), mine, queries, weights)
                            if doc is None or score <= 0:
                                continue
                            if len(heap) < k:
                                heapq.heappush(heap, (score, -doc))
                            elif (score, -doc) > heap[0]:
                                heapq.heapreplace(heap, (score, -doc))
                            if len(heap) == k:
                                limit[q] = heap[0][0]
        out = [(queries.ids[q], -doc, score) for q, heap in enumerate(best) for score, doc in heap]
        cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(cols, ["item_id", "doc_id", "score"])

    return run


def _query_blocks(items: DataFrame, bytes_each: int) -> Iterator[Queries]:
    """Queries in blocks of about so many bytes; rows of one id are one query."""
    rows = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // bytes_each + 1
    terms = F.regexp_extract_all(_lowered(F.col("text")), F.lit(TERM), F.lit(0))
    listed = rows.select("item_id", F.explode(terms).alias("term")).distinct()
    for b in range(blocks):
        mine = listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        got = mine.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        found = Queries([(r["item_id"], r["terms"]) for r in got])
        if found.ids:
            yield found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: first of its rows of each salt, then of those."""
    order = [F.col("score").desc(), F.col("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    last = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return last.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 for each item (item_id, text).

    Null texts have no terms; a document or item without terms takes no part. Every row of ``docs`` is a document:
    repeated rows are ranked one by one. Rows with a null doc_id count in the statistics but cannot be named, so
    they are not ranked. Rows of one item_id, also of the null one, are one item with the terms of all its texts.
    Equal scores are ranked by doc_id. Empty tables give no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for queries in _query_blocks(items, block_bytes):
        counts = docs.mapInArrow(_count(spark.sparkContext.broadcast(queries)), "what long, n long")
        counts = {r["what"]: r["n"] for r in counts.groupBy("what").agg(F.sum("n").alias("n")).collect()}  # one per query term
        documents, terms = counts.get(-1, 0), counts.get(-2, 0)
        if not documents:
            break
        df = [counts.get(i, 0) for i in range(len(queries.hashes))]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df], dtype=np.int64)
        shared = spark.sparkContext.broadcast((queries, weights, documents, terms))
        found = docs.mapInArrow(_search(shared, k), "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return _ranked(out, k)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, len(t)::BIGINT AS n, u AS term, count(*)::BIGINT AS tf
       FROM (SELECT r, doc_id, t, unnest(t) AS u FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM tf, s GROUP BY term, n_docs),
x AS (
  SELECT item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id
), k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


@query("op13_max_sketches", OP13_SQL)
def op13_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
