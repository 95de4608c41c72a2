"""SimHash near-duplicates through tables of Hamming distances to reference fingerprints.

Every distinct fingerprint gets its distances to ``REFERENCES`` fixed random fingerprints, kept per block of bits:
``d(x, r)`` is the sum over blocks of ``d_B(x, r)``. The triangle inequality holds inside each block, so a coordinate
of two fingerprints differs by at most the number of bits they differ in there.

1. With ``k`` differing bits at most and ``k + 3`` blocks, three blocks do not differ at all, so all their coordinates
   are equal. A join on the coordinates of every three blocks therefore meets every pair within the distance,
   and discards without a look the pairs that differ by one or more in some coordinate of every three blocks.
2. Of the pairs that meet, those whose distances to some reference differ by more than ``k`` are discarded
   (largest coordinate difference).
3. The rest is verified on the fingerprints.

A key is not paired out: all its members meet its smallest one, links make components, and only members still in
different components meet each other. Keys that then hold over ``WIDE`` fingerprints are cut again: the bits
they do not share are dealt into ``k + 1`` parts, one of which cannot differ, and so on for three levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.llm.common import discard, stored
from burstseries.llm.components import component_labels
from burstseries.llm.registry import query, table

WIDTH = 64
REFERENCES = 16
SEED = 42
WIDE = 256  # fingerprints of one key that may be paired out
LEVELS = 3
_REFS = [int(x) for x in np.random.default_rng(20250311).integers(-(1 << 63), (1 << 63) - 1, REFERENCES)]


def _signed(mask: int) -> int:
    return mask - (1 << WIDTH) if mask >> (WIDTH - 1) else mask


def simhash(text: bytes, n: int = 4) -> int:
    """Fingerprint of one text: a bit is set if over half of its shingles' hashes have it; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < n:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=">u8")
    ones = np.zeros(WIDTH, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [simhash((t.as_py() or "").encode(), n) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, fp): 64-bit fingerprints as signed longs; a text that is null or without words has 0."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(n), "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    """Bit masks of neighbouring bits, as even as can be."""
    at = [WIDTH * i // blocks for i in range(blocks + 1)]
    return [_signed(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(at, at[1:], strict=False)]


def _coordinates(fp: Column, mask: int) -> Column:
    """Distances to all references within one block, four bits each."""
    out = None
    for i, ref in enumerate(_REFS):
        d = F.bit_count(fp.bitwiseXOR(F.lit(ref)).bitwiseAND(F.lit(mask))).cast("long")
        d = F.shiftleft(d, 4 * i) if i else d
        out = d if out is None else out.bitwiseOR(d)
    return out


def coordinate_keys(prints: DataFrame, distance: int) -> DataFrame:
    """(key, fp, rest): equal keys mean equal coordinates in three blocks; ``rest`` masks the other bits."""
    masks = block_masks(distance + 3)
    coded = prints.select("fp", *[_coordinates(F.col("fp"), m).alias(f"c{i}") for i, m in enumerate(masks)])
    keys = []
    for j, (a, b, c) in enumerate(combinations(range(len(masks)), 3)):
        rest = ~(masks[a] | masks[b] | masks[c])
        keys.append(F.struct(F.xxhash64(F.lit(j), f"c{a}", f"c{b}", f"c{c}").alias("key"), F.lit(rest).alias("rest")))
    return coded.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.key", "fp", "k.rest")


def within(a: str, b: str, distance: int) -> Column:
    """No distance to a reference differs by more than ``distance``, and neither do the fingerprints."""
    far = [F.abs(F.bit_count(F.col(a).bitwiseXOR(F.lit(r))) - F.bit_count(F.col(b).bitwiseXOR(F.lit(r)))) for r in _REFS]
    return (F.greatest(*far) <= distance) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance)


def _part_masks(parts: int, level: int) -> list[int]:
    """All bits dealt into parts, another way on every level."""
    where = np.random.default_rng(level).permutation(WIDTH) % parts
    return [_signed(sum(1 << int(i) for i in np.flatnonzero(where == p))) for p in range(parts)]


def narrower(keyed: DataFrame, distance: int, level: int) -> DataFrame:
    """The rows of ``keyed`` (key, fp, rest, label) under keys that share one more part of their free bits."""
    keys = []
    for p, mask in enumerate(_part_masks(distance + 1, level)):
        bits = F.col("rest").bitwiseAND(F.lit(mask))
        key = F.xxhash64("key", F.lit(p), F.col("fp").bitwiseAND(bits))
        keys.append(F.struct(key.alias("key"), F.col("rest").bitwiseAND(F.lit(~mask)).alias("rest")))
    return keyed.select(F.explode(F.array(*keys)).alias("k"), "fp", "label").select("k.key", "fp", "k.rest", "label")


def _open_keys(keyed: DataFrame) -> DataFrame:
    """(open_key, n): keys whose members lie in different components, and how many members they have."""
    sums = keyed.groupBy(F.col("key").alias("open_key")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    return sums.filter("lo < hi").select("open_key", "n")


def print_components(prints: DataFrame, distance: int = 4, wide: int = WIDE) -> DataFrame:
    """(v, label): the component of every fingerprint of ``prints`` (distinct ``fp``) that is linked with another."""
    keys = coordinate_keys(prints, distance)
    pivots = keys.groupBy(F.col("key").alias("pivot_key")).agg(F.min("fp").alias("pivot"), F.max("fp").alias("top")).filter("pivot < top")
    pivots = stored(pivots.select("pivot_key", "pivot"), "pivot-pivots")
    shared = stored(keys.join(pivots, F.col("key") == F.col("pivot_key")).select("key", "fp", "rest", "pivot"), "pivot-keys")
    star = shared.filter(F.col("fp") != F.col("pivot")).filter(within("fp", "pivot", distance))
    links = stored(star.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(), "pivot-links")
    labels = component_labels(links)

    keyed = shared.join(labels, F.col("fp") == F.col("v"), "left").select("key", "fp", "rest", F.coalesce("label", "fp").alias("label"))
    keyed = stored(keyed, "pivot-labelled")
    discard(pivots, shared)
    found, spent = [links], [keyed, labels]
    for level in range(LEVELS + 1):
        marked = _open_keys(keyed)
        rest = stored(keyed.join(stored(marked, "pivot-open"), F.col("key") == F.col("open_key")).drop("open_key"), f"pivot-rest-{level}")
        spent.append(rest)
        small = rest if level == LEVELS else rest.filter(F.col("n") <= wide)
        x = small.select(F.col("key").alias("key_a"), F.col("fp").alias("a"), F.col("label").alias("label_a"))
        y = small.select(F.col("key").alias("key_b"), F.col("fp").alias("b"), F.col("label").alias("label_b"))
        met = (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b"))
        found.append(stored(x.join(y, met & within("a", "b", distance)).select("a", "b").distinct(), f"pivot-more-{level}"))
        large = rest.filter(F.col("n") > wide)
        if level == LEVELS or large.isEmpty():
            break
        keyed = narrower(large, distance, level)
    late = [f for f in found[1:] if not f.isEmpty()]
    if late:
        for more in late:
            links = links.unionByName(more)
        labels, old = component_labels(links), labels
    else:
        spent.remove(labels)
    discard(*found, *spent)
    return labels


def simhash_components(docs: DataFrame, *, n: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Texts that are null or have no words have the fingerprint zero, linked like any other. ``component_id`` is
    the smallest doc_id reachable over fingerprints that differ in at most ``distance`` bits. A row with a null id
    links others as any row does; its component has the smallest id there is, null if there is none. Rows with
    one id and different texts are one document with several fingerprints. Repeated rows come out as often
    as they come in; an empty table gives no rows; further columns are not looked at.
    """
    prints = stored(fingerprints(docs, n), "pivot-fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "pivot-classes")
    labels = print_components(classes.select("fp"), distance)
    several = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z")
    several = stored(several.select(F.col("doc_id").alias("id"), "a"), "pivot-several")
    if not several.isEmpty():  # ids with several texts: all their fingerprints are one vertex
        more = prints.join(several, F.col("doc_id") == F.col("id")).filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
        labels = component_labels(more.unionByName(labels.select(F.col("v").alias("a"), F.col("label").alias("b"))))
    known = classes.join(labels, F.col("fp") == F.col("v"), "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    known = stored(known, "pivot-known")
    lowest = known.groupBy(F.col("label").alias("of")).agg(F.min("low").alias("component_id"))
    named = known.join(lowest, F.col("label") == F.col("of")).select(F.col("fp").alias("p"), "component_id")
    out = prints.join(stored(named, "pivot-components"), F.col("fp") == F.col("p"))
    discard(classes, labels, several, known)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_pivot_simhash")
def op11_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
