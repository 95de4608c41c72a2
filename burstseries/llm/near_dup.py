"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A document's signature is 48 symbols of 14 bits, one per hash function: the smallest hash over its
shingles, cut to 14 bits. Two sets of similarity s differ in a symbol with probability 1 - s at most, so at
s >= 0.8 more than 23 differing symbols have a chance of a few in a million (at 0.85 one in a hundred million).

The 48 symbols are 12 chunks of 4. Two signatures with at most 23 differing symbols have, by the pigeonhole
principle, a chunk with at most one. All chunk values with one error are covered by the four keys a chunk has
when each of its places in turn is left out: two chunks agree in one of those keys exactly if they differ in
at most one symbol. So the join on (chunk, place left out, other three symbols) finds every pair of signatures
under the distance threshold.

Equal shingle sets are first merged into one class. Classes that share a key are not all paired: each key
has a pivot, its smallest id, and every member is paired with it. Pairs within the signature distance are
confirmed on their full sets, confirmed links make components, and only keys whose members are then still in
different components are joined again, between components alone. A pair that is never looked at is thus
in one component already, so no link between different components is lost.

Before full sets are moved, a pair must pass a bound that holds for certain. Each document that shares a key has
1024 bits, one per range of shingle hashes, set where it has a shingle. A bit that only one of two documents has
is a shingle the other lacks, so counting them gives the largest intersection the pair can have. Pairs of keys
joined again, whose number grows faster than the documents, pass the same bound with eight ranges a shingle next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.llm.common import Words, discard, gram_hashes, list_array, mix, signed, starts, stored, text_pieces, whole_groups
from burstseries.llm.components import component_labels
from burstseries.llm.registry import query, table

CHUNKS, PLACES, BITS = 12, 4, 14
SYMBOLS = CHUNKS * PLACES
MAX_DISTANCE = 23  # guaranteed to be found: 2 * CHUNKS - 1
FIELD = BITS + 1  # a spare bit per symbol for the comparison
_FILL = sum(((1 << BITS) - 1) << (FIELD * i) for i in range(PLACES))
_GUARD = sum(1 << (FIELD * i + BITS) for i in range(PLACES))
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
CHUNK_NAMES = [f"c{i}" for i in range(CHUNKS)]
RANGES = 1024  # bits a document has for the bound on intersections
RANGE_NAMES = [f"b{i}" for i in range(RANGES // 64)]
CELL = 1 << 12  # about how many rows of a key are held against as many others by one task
AT_ONCE = 1 << 18  # pairs looked at together


def shingle_sets(piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many per row): the distinct ``n``-word shingles of each row, sorted within the row.

    A row with fewer words, but some, has one shingle, its whole sequence of words.
    """
    words = Words(piece)
    h = words.hashes
    grams = gram_hashes(h, n)
    row = words.row[: len(grams)]
    whole = words.row[n - 1 :] == row if len(grams) else np.zeros(0, dtype=bool)
    grams, row = grams[whole], row[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        more = []
        for r in short:
            x = h[words.first[r] : words.first[r + 1]]
            more.append(mix(gram_hashes(x, len(x)) + np.uint64(len(x)))[0])
        grams, row = np.concatenate([grams, np.array(more, dtype=np.uint64)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        grams, row = grams[order], row[order]
    counts = np.bincount(row, minlength=piece.rows)
    at = np.cumsum(counts) - counts
    out, sizes = [], np.zeros(piece.rows, dtype=np.int64)
    for r in np.flatnonzero(counts):
        x = np.unique(grams[at[r] : at[r] + counts[r]])
        sizes[r] = len(x)
        out.append(x)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), sizes


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                grams, sizes = shingle_sets(piece, n)
                have = np.flatnonzero(sizes)
                first = (np.cumsum(sizes) - sizes)[have]
                chunks = np.zeros((CHUNKS, piece.rows), dtype=np.int64)
                prints = np.zeros((2, piece.rows), dtype=np.uint64)
                if len(have):
                    for k in range(SYMBOLS):
                        least = np.minimum.reduceat((grams ^ _XOR[k]) * _MUL[k], first)
                        symbol = (mix(least) >> np.uint64(64 - BITS)).astype(np.int64)
                        chunks[k // PLACES][have] |= symbol << (FIELD * (k % PLACES))
                    prints[0][have] = np.add.reduceat(mix(grams + np.uint64(1)), first)
                    prints[1][have] = np.add.reduceat(mix(grams ^ np.uint64(0x5BD1E9955BD1E995)), first)
                cols = [piece.column("doc_id"), pa.array(sizes), *[pa.array(signed(p)) for p in prints]]
                cols += [pa.array(c) for c in chunks]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "f1", "f2", *CHUNK_NAMES])

    return run


def signatures(docs: DataFrame, n: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, f1 long, f2 long, " + ", ".join(f"{c} long" for c in CHUNK_NAMES)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signatures(n), schema)


def _distance(a: str, b: str) -> Column:
    """Differing symbols: a symbol that differs carries into its spare bit."""
    out = None
    for c in CHUNK_NAMES:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        d = F.bit_count((x + F.lit(_FILL)).bitwiseAND(F.lit(_GUARD)))
        out = d if out is None else out + d
    return out


def index_keys(reps: DataFrame) -> DataFrame:
    """(key, id): 48 keys a signature, each a chunk with one of its places left out."""
    keys = []
    for i, c in enumerate(CHUNK_NAMES):
        for j in range(PLACES):
            at, slot = 0, None
            for p in range(PLACES):
                if p != j:
                    s = F.shiftleft(F.shiftright(F.col(c), FIELD * p).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * at)
                    slot = s if slot is None else slot.bitwiseOR(s)
                    at += 1
            keys.append(slot.bitwiseOR(F.lit((i * PLACES + j) << (3 * BITS))))
    return reps.select(F.explode(F.array(*keys)).alias("key"), F.col("id"))


def range_bits(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of 64-bit numbers per document: the ranges of hashes in which it has a shingle."""
    bits = np.zeros((len(sizes), RANGES), dtype=bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), (grams >> np.uint64(64 - 10)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def fine_bits(grams: np.ndarray) -> bytes:
    """The ranges of hashes in which a document has a shingle, eight ranges a shingle at least."""
    power = max(10, (8 * len(grams) - 1).bit_length())
    bits = np.zeros(1 << power, dtype=bool)
    bits[(grams >> np.uint64(64 - power)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch):
                grams, sizes = shingle_sets(piece, n)
                each = np.split(grams, np.cumsum(sizes)[:-1])
                cols = [piece.column("id"), list_array(signed(grams), sizes, pa.int64()), pa.array(map(fine_bits, each), pa.binary())]
                cols += [pa.array(np.ascontiguousarray(c)) for c in range_bits(grams, sizes).T]
                yield pa.RecordBatch.from_arrays(cols, ["id", "grams", "fine", *RANGE_NAMES])

    return run


def _confirm(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("grams_a"), batch.column("grams_b")
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep[i] = 100 * both >= share * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return run


def candidate_sets(ids: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(id, grams, bits of the ranges, fine and coarse): full sets of the documents named by ``ids``, made again from their texts.

    Both passes over pairs read the bits and both confirming passes the sets, so the texts are shuffled once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    schema = "id long, grams array<long>, fine binary, " + ", ".join(f"{b} long" for b in RANGE_NAMES)
    return stored(texts.mapInArrow(_sets(n), schema), "near-sets")


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= share * union of their full sets, over two plain joins."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    return two.select("a", "b", "grams_a", "grams_b").mapInArrow(_confirm(share), "a long, b long")


def most_common(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """The largest intersection that two sets with these bits can have; the finer bits are folded."""
    x, y = (np.unpackbits(np.frombuffer(v, dtype=np.uint8)) for v in (a, b))
    if len(x) != len(y):
        width = min(len(x), len(y))
        x, y = (v.reshape(width, -1).max(axis=1) for v in (x, y))
    # of a document's shingles those in ranges of its own are no common ones
    return int((x & y).sum()) + min(size_a - int(x.sum()), size_b - int(y.sum()))


def _may_be_similar(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("fine_a", "fine_b", "size_a", "size_b"))
            keep = [(100 + share) * most_common(*v) >= share * (v[2] + v[3]) for v in zip(a, b, x, y, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    return run


def may_be_similar(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose fine bits, an eighth of the room of the full sets, allow the similarity."""
    bits = sets.select("id", "fine", F.size("grams").alias("size"))
    for c in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("id").alias(c), F.col("fine").alias(f"fine_{c}"), F.col("size").alias(f"size_{c}")), c)
    # an id with several texts has all combinations
    return pairs.select("a", "b", "fine_a", "fine_b", "size_a", "size_b").mapInArrow(_may_be_similar(share), "a long, b long").distinct()


def _common(a: str, b: str) -> Column:
    """Ranges in which both have a shingle."""
    out = None
    for c in RANGE_NAMES:
        d = F.bit_count(F.col(f"{a}.{c}").bitwiseAND(F.col(f"{b}.{c}")))
        out = d if out is None else out + d
    return out


def _close(a: str, b: str, share: int) -> Column:
    """Sizes and ranges that allow the similarity, and signatures within the distance.

    Of a document's shingles those in ranges of its own are no common ones: at most the common ranges and
    what it has beyond one per range (``spare``) are.
    """
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = 100 * F.least(x, y) >= share * F.greatest(x, y)
    both = _common(a, b) + F.least(f"{a}.spare", f"{b}.spare")
    return sizes & (_distance(a, b) <= MAX_DISTANCE) & ((100 + share) * both >= share * (x + y))


def _first_shared(key: int, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows ``i`` and ``j`` with one key meet under the first one that their signatures share.

    No earlier chunk may have at most one differing symbol; within the chunk, one that does not differ at all counts
    for its first place only.
    """
    chunk, place = divmod(key >> (3 * BITS), PLACES)
    first = np.ones(len(i), dtype=bool)
    for k in range(chunk):
        first &= np.bitwise_count(((c[k][i] ^ c[k][j]) + _FILL) & _GUARD) > 1
    if place:
        first &= ((c[chunk][i] ^ c[chunk][j]) >> (FIELD * place)) & ((1 << BITS) - 1) != 0
    return first


def _pairs_of_sizes(n: np.ndarray, m: np.ndarray | None, share: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with sizes that allow the similarity, ``AT_ONCE`` or so at a time; sizes rise. Without ``m``, i < j."""
    if m is None:
        m, lo = n, np.arange(1, len(n) + 1)
    else:
        lo = np.searchsorted(m, -(-share * n // 100), "left")
    size = np.maximum(np.searchsorted(m, 100 * n // share, "right") - lo, 0)
    ends = np.cumsum(size)
    at = 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)))
        mine = size[at:upto]
        i = np.repeat(np.arange(at, upto), mine)
        yield i, lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(mine) - mine, mine)
        at = upto


def _apart(share: int):
    """Rows sorted by key and cell -> the pairs of a cell, of different components, that ``_close`` lets pass."""
    names = ["key", "cell", "block", "id", "label", "n_shingles", "spare", *CHUNK_NAMES, *RANGE_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_groups(batches, ["key", "cell"]):
            order = np.lexsort([cols[names.index(k)] for k in ("n_shingles", "block", "cell", "key")])
            key, cell, block, ident, label, n, spare, *rest = (c[order] for c in cols)
            chunks, ranges = rest[:CHUNKS], [r.view(np.uint64) for r in rest[CHUNKS:]]  # bits are counted of absolute values
            found = []
            at = starts(key, cell)
            for lo, hi in zip(at, np.append(at[1:], len(key)), strict=True):
                if hi - lo < 2:
                    continue
                # the cell is one block, held against itself, or two
                cut = lo + int(np.searchsorted(block[lo:hi], block[hi - 1]))
                if cell[lo] >= 0 and cut == lo:
                    continue
                one, two = (n[lo:cut], n[cut:hi]) if cell[lo] >= 0 else (n[lo:hi], None)
                for i, j in _pairs_of_sizes(one, two, share):
                    i, j = i + lo, j + (lo if two is None else cut)
                    keep = (label[i] != label[j]) & (ident[i] != ident[j])
                    i, j = i[keep], j[keep]
                    distance = np.zeros(len(i), dtype=np.int64)
                    for k, c in enumerate(chunks, 1):
                        distance += np.bitwise_count(((c[i] ^ c[j]) + _FILL) & _GUARD)
                        if k in (8, 10, CHUNKS):
                            keep = distance <= MAX_DISTANCE
                            i, j, distance = i[keep], j[keep], distance[keep]
                    keep = _first_shared(int(key[lo]), chunks, i, j)
                    i, j = i[keep], j[keep]
                    both = sum((np.bitwise_count(b[i] & b[j]).astype(np.int64) for b in ranges), np.minimum(spare[i], spare[j]))
                    keep = (100 + share) * both >= share * (n[i] + n[j])
                    a, b = ident[i[keep]], ident[j[keep]]
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run, names


def pairs_apart(rows: DataFrame, share: int) -> DataFrame:
    """(a, b), a < b: pairs of ``rows`` that share a key, lie in different components and may be similar enough.

    A key with many rows is dealt into blocks by id; each two blocks, and each with itself, are a cell of their own.
    """
    run, names = _apart(share)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / CELL)).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    two = F.least("other", "block").cast("long") * F.lit(1 << 20) + F.greatest("other", "block")
    dealt = rows.withColumn("block", block).withColumn("other", other)
    dealt = dealt.withColumn("cell", F.when(F.col("other") == F.col("block"), -1 - F.col("block").cast("long")).otherwise(two))
    dealt = dealt.select(*names).repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, n: int = 3, share: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Texts without words have no shingles and are linked with nothing; so are rows with a null id, which
    have a null component and are kept. Repeated rows come out as often as they come in. Ids name
    documents: rows with one id and different texts are one document of several texts, and the component
    of the id is that of all of them.
    """
    spent: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        spent.append(stored(df, name))
        return spent[-1]

    sig = stored(signatures(docs, n), "near-signatures")
    linked = sig.filter("n_shingles > 0 and doc_id is not null")
    first = linked.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("id"))
    first = keep(first, "near-classes")
    member = keep(linked.join(first, ["n_shingles", "f1", "f2"]), "near-members")
    copies = member.filter(F.col("doc_id") != F.col("id")).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    reps = member.filter(F.col("doc_id") == F.col("id")).select("id", "n_shingles", *CHUNK_NAMES)
    reps = keep(reps.dropDuplicates(["id", "n_shingles", *CHUNK_NAMES]), "near-representatives")

    keys = index_keys(reps)
    pivots = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).filter("pivot < top")
    shared = keep(keys.join(keep(pivots.select("key", "pivot"), "near-pivots"), "key"), "near-keys")
    star = shared.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    sets = candidate_sets(keep(shared.select("id").distinct(), "near-candidates"), docs, n)
    # an id with several texts gets all combinations; the pairs that are wanted are among them
    ranges = sum((F.bit_count(b) for b in RANGE_NAMES), F.lit(0))
    parts = reps.join(sets.select("id", *RANGE_NAMES, (F.size("grams") - ranges).alias("spare")), "id")
    parts = keep(parts, "near-parts")
    star = star.join(parts.alias("x"), F.col("a") == F.col("x.id")).join(parts.alias("y"), F.col("b") == F.col("y.id"))
    star = keep(star.filter(_close("x", "y", share)).select("a", "b").distinct(), "near-star")
    links = keep(confirm(star, sets, share), "near-links")
    labels = component_labels(links.unionByName(copies))

    # keys whose members are still apart: join them between components
    label = labels.withColumnsRenamed({"v": "id"})
    keyed = shared.join(label, "id", "left").select("key", "id", "pivot", F.coalesce("label", "id").alias("label"))
    keyed = keep(keyed, "near-keyed")
    apart = keyed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows"))
    apart = keep(apart.filter("lo < hi").select("key", "rows"), "near-apart")
    # the pivot has met all others
    rest = keyed.filter("id <> pivot").join(apart, "key").join(parts, "id")
    more = pairs_apart(rest.select("key", "rows", "id", "label", "n_shingles", "spare", *CHUNK_NAMES, *RANGE_NAMES), share)
    more = keep(may_be_similar(keep(more, "near-more"), sets, share), "near-maybe")
    late = keep(confirm(more, sets, share), "near-late-links")
    if not late.isEmpty():
        labels = component_labels(links.unionByName(copies).unionByName(late))
    discard(*spent, sets)  # the result reads the signatures and the labels
    out = sig.join(labels, sig["doc_id"] == labels["v"], "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("label")), F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def representatives(docs: DataFrame, *, n: int = 5, share: int = 80) -> DataFrame:
    """The documents with one of each near-duplicate group left (its smallest id), all columns as they were.

    Of repeated rows of one id one stays. Rows without an id stay as they are.
    """
    got = near_duplicates(docs, n=n, share=share).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(stored(got, "near-kept"), docs["doc_id"] == F.col("__id"), "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b
  WHERE 100 * c.n >= 85 * (len(p.s) + len(q.s) - c.n)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, t) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.v, e.b FROM r JOIN e ON r.t = e.a
), m AS (SELECT v, min(t) AS t FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.t AS component_id, s.doc_id = m.t AS kept
FROM s JOIN m ON m.v = s.doc_id
"""


@query("op2_minhash_hamming", OP2_SQL)
def op2_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
