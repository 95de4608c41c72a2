"""Shared pieces: the word pattern, stored intermediates and vectorised passes over Arrow text buffers.

A text column of an Arrow batch is one contiguous byte buffer with row offsets. The helpers here cut a
batch into pieces of bounded size along row borders and find words and their hashes in the whole piece
at once, so a pass costs a few NumPy sweeps over the bytes and no Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstseries.session import _WRITTEN, fresh_path

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PLANNED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Bytes of text handled at once inside a task; a longer row forms a piece of its own.
PIECE = 2 << 20
#: Sorted rows handled at once.
HOLD = 1 << 17


def stored(df: DataFrame, name: str, measured: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back; the shuffle files of its job go at once.

    Read again after an executor is lost, it costs no recomputation. ``discard`` deletes it once nothing
    reads it any more. With ``measured`` no join of the job broadcasts a side by its planned size, which takes
    compressed files, and rows before they are exploded, for what they unfold to; only a side that was shuffled
    and found small is.
    """
    spark = df.sparkSession
    conf = {CLEANUP: "true"}
    if measured:
        conf |= {PLANNED: "-1", MEASURED: spark.conf.get(MEASURED, None) or spark.conf.get(PLANNED)}
    before = {k: spark.conf.get(k, None) for k in conf}
    path = fresh_path(spark, name)
    _WRITTEN.setdefault(id(spark._jsparkSession), []).append(path)  # drop_scratch deletes what is still there
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote; only for tables that no pending result reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def word_count(text: Column | str) -> Column:
    """Number of words as a long; a null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column | str, mod: int) -> Column:
    """``crc32`` of the id as text, modulo ``mod``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


# --- pieces of text ---------------------------------------------------------------------------------


class Piece:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and the rows' offsets into them."""

    def __init__(self, batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offs: np.ndarray):
        self.batch, self.lo, self.hi, self.data, self.offs = batch, lo, hi, data, offs

    def column(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.lo, self.hi - self.lo)

    def numbers(self, name: str) -> np.ndarray:
        return self.column(name).to_numpy(zero_copy_only=False)

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def text_pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[Piece]:
    """Pieces of about ``limit`` bytes; null texts are empty."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("")
    if not len(arr):
        return
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)
    offs = offs[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    whole = np.frombuffer(arr.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, len(arr))
        yield Piece(batch, lo, hi, whole[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE), np.full(n, _BASE_INV)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    return _powers(max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``S`` such that the bytes from s to e hash to ``(S[e] - S[s]) * inverse_power[s]``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a piece: byte ranges, the row each belongs to and the first word of each row."""

    def __init__(self, piece: Piece, lower: bool = True):
        data = piece.data
        solid = ~_SPACE[data]
        before = np.empty(len(data) + 1, dtype=bool)
        before[0] = False
        before[1:] = solid
        cut = piece.offs[(piece.offs > 0) & (piece.offs < len(data))]
        starts_at = solid & ~before[:-1]
        starts_at[cut] = solid[cut]
        ends_at = np.empty(len(data), dtype=bool)
        if len(data):
            ends_at[:-1] = solid[:-1] & ~solid[1:]
            ends_at[-1] = solid[-1]
            ends_at[cut - 1] = solid[cut - 1]
        self.starts = np.flatnonzero(starts_at)
        self.ends = np.flatnonzero(ends_at) + 1
        self.first = np.searchsorted(self.starts, piece.offs)  # rows + 1 borders
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(piece.rows), self.counts)
        self._data, self._lower = data, lower

    @property
    def hashes(self) -> np.ndarray:
        data = _LOWER[self._data] if self._lower else self._data
        return range_hashes(prefix_sums(data), self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` words from each word on; the last ``n - 1`` entries are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out = (out + hashes[j : j + m]) * _BASE
        out ^= out >> np.uint64(31)
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours; ``len(x) - width + 1`` values."""
    if len(x) < width:
        return x[:0]
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values of all rows one after the other, and how many each row has."""
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))


# --- sorted rows -----------------------------------------------------------------------------------


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of rows that come sorted by ``keys``, many rows at a time; rows of one key are never parted."""
    held: list[list[np.ndarray]] = []
    size = 0
    names: list[str] = []
    for batch in batches:
        names = batch.schema.names
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < HOLD:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        same = np.ones(size, dtype=bool)
        for k in keys:
            c = cols[names.index(k)]
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield [c[:cut] for c in cols]
        held, size = [[c[cut:] for c in cols]], size - cut
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def starts(*cols: np.ndarray) -> np.ndarray:
    """Where rows that are sorted differ from the row before."""
    new = np.zeros(len(cols[0]), dtype=bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
