"""Exact substring dedup by distributed prefix doubling.

Every byte covered by a 50-byte string that also starts in a document with a smaller id goes. Sorting all
positions of a corpus by rank pairs would move every byte many times over, so positions are ranked in two
steps, and those that have become unique leave after each:

1. *Length 24, at anchors.* The anchor of a 50-byte window is the place in it where a 24-byte string has
   the smallest hash; equal windows have equal anchors, one in about fourteen positions. Spark deals anchors
   by their name, the hash of 24 bytes; a name that only one text has is unique, and all windows at that
   anchor are unique with it.
2. *Lengths 8, 16, 32 and 50, at every window left.* Consecutive windows with one anchor travel as one run
   of bytes, dealt by the anchor's name, so all windows that could be equal meet. There ranks are doubled: the
   rank of 2h bytes at i is that of the sorted pair (rank of h bytes at i, at i + h), the last step pairs
   32 bytes at i and at i + 18, the threshold. These are exact ranks of bytes, not hashes. A window goes where
   its rank also has a smaller document.

Copies are settled before they are moved: whole texts by their SHA-256, runs by their hash with partial sums,
so what meets in a task is distinct. Anchor names shared by very many distinct runs (a common phrase in ever
new surroundings) are ranked as single 50-byte strings with partial sums instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.llm.common import discard, mix, powers, prefix_sums, range_hashes, signed, sliding_min, stored, text_pieces
from burstseries.llm.registry import query, table

LENGTH = 50
GRAM = 24
WIDTH = LENGTH - GRAM + 1
SLICE = 1 << 18  # bytes of text swept at once: fits the processor's cache
HELD = 1 << 20  # anchors held by a task before they are sent
BUCKET = 8 << 20  # bytes of text whose anchors share a bucket
RUNS = 40_000  # runs a bucket of the second step
HOT = 5_000  # distinct runs of one anchor name above which windows are ranked one by one
_PLACE = np.uint64((1 << 30) - 1)


def window_runs(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor, anchor's hash) of each run; places count within the row."""
    data, n = piece.data, len(piece.data)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none, none, none, none, np.zeros(0, dtype=np.uint64)
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(key, WIDTH) & _PLACE).astype(np.int64)
    valid = np.ones(len(anchor), dtype=bool)
    for b in piece.offs[1:-1]:
        valid[max(0, b - LENGTH + 1) : b] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none, np.zeros(0, dtype=np.uint64)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    windows = np.flatnonzero(last) - start + 1
    row = np.searchsorted(piece.offs, start, side="right") - 1
    at = anchor[start]
    off = piece.offs[row]
    return row, start - off, windows, at - off, grams[at]


def _anchors(buckets: int):
    names = ["bucket", "names", "prints", "places"]

    def send(held: list) -> pa.RecordBatch:
        h, p, at = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        present, first = np.unique(bucket[order], return_index=True)
        cols = [[x.tobytes() for x in np.split(v[order], first[1:])] for v in (h, p, at.astype("<i4"))]
        return pa.RecordBatch.from_arrays([pa.array(present), *[pa.array(c, pa.binary()) for c in cols]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0
        for batch in batches:
            for piece in text_pieces(batch, limit=SLICE):
                row, _, _, at, h = window_runs(piece)
                if not len(row):
                    continue
                held.append((h, piece.numbers("print")[row].astype(np.int64), at))
                n += len(row)
                if n >= HELD:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    return run


def _shared(t: pa.Table) -> pa.Table:
    """(print, place) of the anchors of a bucket whose name two texts have; copies of a text count once."""
    def whole(c: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=kind)

    h, p, at = whole("names", "<u8"), whole("prints", "<i8"), whole("places", "<i4")
    order = np.argsort(h, kind="stable")
    h, p, at = h[order], p[order], at[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
    differ = np.minimum.reduceat(p, first) != np.maximum.reduceat(p, first) if len(h) else np.zeros(0, dtype=bool)
    keep = np.repeat(differ, np.diff(np.append(first, len(h))))
    p, at = p[keep], at[keep]
    order = np.lexsort((at, p))
    p, at = p[order], at[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1])
    return pa.table({"print": pa.array(p[new]), "place": pa.array(at[new])})


def _kept_runs(batch: pa.RecordBatch):
    """Per piece, the runs of windows at the anchors that are left: (piece, row, start, windows, name, print)."""
    spots = batch.column("places")
    flat, offs = spots.values.to_numpy(), spots.offsets.to_numpy()
    for piece in text_pieces(batch, limit=SLICE):
        row, start, windows, at, h = window_runs(piece)
        left = np.zeros(len(piece.data) + 1, dtype=bool)
        mine = np.repeat(np.arange(piece.rows), np.diff(offs[piece.lo : piece.hi + 1]))
        left[flat[offs[piece.lo] : offs[piece.hi]] + piece.offs[mine]] = True
        keep = left[at + piece.offs[row]]
        row, start, windows, h = row[keep], start[keep], windows[keep], h[keep]
        begin = piece.offs[row] + start
        yield piece, row, start, windows, h, range_hashes(prefix_sums(piece.data), begin, begin + windows + LENGTH - 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, row, start, windows, name, whole in _kept_runs(batch):
            doc = piece.numbers("doc_id")[row].astype(np.int64) if len(row) else row
            cols = [signed(name), signed(whole), doc, start.astype(np.int32), windows.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["name", "print", "doc_id", "start", "windows"])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for (arrays starts, windows, buckets of a row)."""
    for batch in batches:
        offs = batch.column("runs").offsets.to_numpy()
        item = batch.column("runs").values
        starts, windows, buckets = (item.field(c).to_numpy() for c in ("start", "windows", "bucket"))
        for piece in text_pieces(batch, limit=SLICE):
            lo, hi = offs[piece.lo], offs[piece.hi]
            row = np.repeat(np.arange(piece.rows), np.diff(offs[piece.lo : piece.hi + 1]))
            size = windows[lo:hi].astype(np.int64) + LENGTH - 1
            cut = np.zeros(len(row) + 1, dtype=np.int64)
            np.cumsum(size, out=cut[1:])
            begin = piece.offs[row] + starts[lo:hi]
            text = piece.data[np.repeat(begin - cut[:-1], size) + np.arange(cut[-1])]
            blob = pa.Array.from_buffers(
                pa.binary(), len(row), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())]
            )
            doc = piece.numbers("doc_id")[row].astype(np.int64) if len(row) else row
            cols = [pa.array(buckets[lo:hi]), pa.array(doc), pa.array(starts[lo:hi]), blob]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "doc_id", "start", "bytes"])


def _rank(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def repeated_windows(data: np.ndarray, offs: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, window) of the windows that a smaller document among these runs has too, by prefix doubling.

    ``data``: the runs' bytes one after the other, ``offs``: their borders, ``doc``: their documents.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(doc):
        return none, none
    n = len(data) - 7
    rank = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        rank = (rank << np.uint64(8)) | data[j : j + n]
    rank = _rank(rank)
    for have, step in ((8, 8), (16, 16), (32, LENGTH - 32)):
        n -= step
        rank = (rank[:n] << np.uint64(32)) | rank[step : step + n]
        if have < 32:
            rank = _rank(rank)
    # windows that start inside a run and end in it
    windows = np.diff(offs) - LENGTH + 1
    run = np.repeat(np.arange(len(doc)), windows)
    place = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    name = _rank(rank[offs[run] + place]).astype(np.int64)
    low = np.full(int(name.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, name, doc[run])
    gone = low[name] < doc[run]
    return run[gone], place[gone]


def _repeated(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    b = t.column("bytes").combine_chunks()
    b = b.chunk(0) if isinstance(b, pa.ChunkedArray) else b
    offs = np.frombuffer(b.buffers()[1], dtype=np.int32)[b.offset : b.offset + len(b) + 1].astype(np.int64)
    data = np.frombuffer(b.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
    doc, start = t.column("doc_id").to_numpy(), t.column("start").to_numpy()
    run, place = repeated_windows(data, offs - offs[0], doc)
    first = np.ones(len(run), dtype=bool)
    first[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)
    last = np.append(first[1:], True) if len(run) else first
    lo, hi = start[run[first]] + place[first], start[run[last]] + place[last] + LENGTH
    return pa.table({"doc_id": pa.array(doc[run[first]]), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})


def repeated_spans(docs: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lo, hi) of removed byte ranges, overlapping, of distinct texts; and those texts (doc_id, text).

    ``prints``: (doc_id, print, lead): a number for each document's text, and the smallest id with that text.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    named = docs.select(_print(F.col("text")).alias("print"), "text")
    sent = named.mapInArrow(_anchors(buckets), "bucket long, names binary, prints binary, places binary")
    left = sent.groupBy("bucket").applyInArrow(_shared, "print long, place int")
    left = left.groupBy("print").agg(F.collect_list("place").alias("places"))
    lead = prints.filter("doc_id = lead").select("doc_id", "print").distinct()
    left = stored(left.join(lead, "print").select(F.col("doc_id").alias("__id"), "places"), "suffix-anchors")
    texts = docs.join(left, docs["doc_id"] == left["__id"]).select("doc_id", "text", "places")
    texts = stored(texts.dropDuplicates(["doc_id"]) if _repeats(prints) else texts, "suffix-texts")

    discard(left)

    # runs by name and hash only: their bytes travel later, where they are needed
    runs = texts.mapInArrow(_runs, "name long, print long, doc_id long, start int, windows int")
    same = runs.groupBy("name", "print").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"))
    same = stored(same.filter("lead < last").select("name", "print", "lead"), "suffix-same")
    led = runs.join(same, ["name", "print"], "left").select(
        "name", "doc_id", "start", "windows", (F.col("doc_id") > F.col("lead")).alias("copy")
    )
    led = stored(led.withColumn("copy", F.coalesce("copy", F.lit(False))), "suffix-runs")
    discard(same)
    end = F.col("start") + F.col("windows") + (LENGTH - 1)
    whole = stored(led.filter("copy").select("doc_id", F.col("start").alias("lo"), end.alias("hi")), "suffix-copies")
    rest = led.filter("not copy").drop("copy")
    names = rest.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    names = stored(names.filter("a < b").select("name", "n"), "suffix-names")
    n_runs, most = names.agg(F.sum("n"), F.max("n")).first()
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), (n_runs or 0) // RUNS)
    # bucket -1: names so common that their windows are ranked one by one
    bucket = F.when(F.col("n") > HOT, F.lit(-1)).otherwise(F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int"))
    asked = rest.join(names, "name").select("doc_id", F.struct("start", "windows", bucket.alias("bucket")).alias("run"))
    asked = asked.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("run").alias("runs"))
    asked = stored(asked, "suffix-asked")
    discard(led, names)
    moved = texts.join(asked, texts["doc_id"] == asked["__id"]).select("doc_id", "text", "runs")
    moved = moved.mapInArrow(_bytes, "bucket int, doc_id long, start int, bytes binary")
    found = moved.filter("bucket >= 0").groupBy("bucket").applyInArrow(_repeated, "doc_id long, lo int, hi int")
    spans = whole.unionByName(stored(found, "suffix-found"))
    if (most or 0) > HOT:
        spans = spans.unionByName(stored(_one_by_one(moved.filter("bucket < 0")), "suffix-found-hot"))
    discard(asked)
    return spans, texts


def _one_by_one(runs: DataFrame) -> DataFrame:
    """Single windows as rows: the smallest document of each is found with partial sums."""
    at = F.sequence(F.lit(0), F.octet_length("bytes") - LENGTH)
    w = runs.select("doc_id", "start", "bytes", F.explode(at).alias("i"))
    w = w.select("doc_id", (F.col("start") + F.col("i")).alias("lo"), F.substring("bytes", F.col("i") + 1, F.lit(LENGTH)).alias("w"))
    w = stored(w, "suffix-windows")
    low = stored(w.groupBy("w").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).filter("lead < last"), "suffix-leads")
    got = w.join(low.select("w", "lead"), "w").filter("doc_id > lead")
    return got.select("doc_id", "lo", (F.col("lo") + LENGTH).alias("hi"))


def _print(text):
    """60 bits of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long")


def _repeats(prints: DataFrame) -> bool:
    return not prints.groupBy("doc_id").count().filter("count > 1").limit(1).isEmpty()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spots = batch.column("spans")
        lo, hi, offs = spots.values.field("lo").to_numpy(), spots.values.field("hi").to_numpy(), spots.offsets.to_numpy()
        removed, count, sha, kept = [], [], [], []
        for piece in text_pieces(batch):
            for i in range(piece.rows):
                k = piece.lo + i
                a, b = lo[offs[k] : offs[k + 1]], hi[offs[k] : offs[k + 1]]
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                cut = np.append(True, a[1:] > b[:-1])
                a, b = a[cut], b[np.append(np.flatnonzero(cut)[1:] - 1, len(b) - 1)]
                text = piece.text(i)
                rest = b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True))
                removed.append(len(text) - len(rest))
                count.append(len(a))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
        cols = [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["t_id", "t_removed", "t_spans", "t_sha", "kept"])


def exact_dedup(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and ``kept`` bytes if asked for.

    Texts are UTF-8 bytes, a null text is empty, texts under 50 bytes keep all. Rows of one id do not count
    as smaller than each other; rows without an id lose nothing and take nothing from others. Rows of
    one id must have one text.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    text = F.coalesce("text", F.lit(""))
    info = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    info = stored(info.withColumn("print", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")), "suffix-info")
    lead = stored(info.filter("doc_id is not null").groupBy(F.col("sha").alias("l_sha")).agg(F.min("doc_id").alias("lead")), "suffix-lead")
    info = stored(info.join(lead, info["sha"] == lead["l_sha"], "left").drop("l_sha"), "suffix-led-info")
    spans, texts = repeated_spans(docs.filter("doc_id is not null"), info.filter("doc_id is not null"))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = texts.select("doc_id", "text").join(spans, "doc_id")
    cut = cut.mapInArrow(_digest, "t_id long, t_removed long, t_spans long, t_sha string, kept binary")
    if not with_text:
        cut = cut.drop("kept")
    out = info.join(cut, info["doc_id"] == cut["t_id"], "left")
    copy = (F.col("doc_id") > F.col("lead")) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    cols = [
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("t_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("t_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("t_sha", "sha")).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*cols)
    whole = docs.select(F.col("doc_id").alias("w_id"), F.coalesce("text", F.lit("")).cast("binary").alias("whole"))
    out = out.join(whole, out["doc_id"].eqNullSafe(whole["w_id"]))
    kept = F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", "whole"))
    return out.select(*cols, kept.alias("kept"))


@query("op1_suffix_doubling")
def op1_suffix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
