"""Alignment of two tokenizers' tokens by diagonal run skipping, and how often token pairs are linked corpus-wide.

Both encodings of a text spell the same bytes, so a token is known by the byte where it ends. The two rising
arrays of ends are walked together. While both encodings cut alike, the places in the two arrays differ by a
constant shift: slices of 1, 2, 4, ... ends are compared at that shift, and a slice that is equal is jumped as
one-to-one groups; after a slice that is not, the length is halved until the run's end is found. There the
encodings cut differently: the side that lags is moved on until both end at the same byte, which makes one
irregular group and a new shift.

The tokens of a group are linked, every one of A with every one of B. A document's distinct links are written
once; counting them over the corpus is a grouping with partial sums, and the counts come back by a join: the most
frequent pairs, at most ``HOT_PAIRS``, are broadcast, the rest is shuffled by pair.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.llm.common import discard, stored
from burstseries.llm.registry import query, table

SHIFT = 32  # a pair is A's id above B's
HOT_PAIRS = 1 << 20  # pairs that may be broadcast: 17 bytes each
FLUSH = 1 << 20  # links gathered before a batch is handed on
SMALL = 4096  # links of a group that are listed one by one


def default_vocabularies() -> tuple[str, str]:
    """(rank file of A: 50k byte-level BPE, model file of B: 32k pieces with byte fallback)."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model")


class Spelling:
    """Bytes of each id of a vocabulary and their lengths."""

    def __init__(self, tokens: dict[int, bytes]):
        n = max(tokens) + 1
        self.bytes = [tokens.get(i, b"") for i in range(n)]
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, n)

    def whole(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class ByteTokens:
    """A: byte-level BPE from the rank form of its vocabulary, whose ids are those of its other form."""

    def __init__(self, path: str):
        import public_tokenizers as public
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._enc = tiktoken.Encoding("a", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spelling = Spelling({i: token for token, i in ranks.items()})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._enc.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    """B: pieces; U+2581 is a space and <0xHH> a byte. The space before the text is its own."""

    def __init__(self, path: str):
        import sentencepiece

        self._enc = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelling = Spelling({i: self._bytes(self._enc.id_to_piece(i)) for i in range(self._enc.get_piece_size())})

    @staticmethod
    def _bytes(piece: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._enc.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizer_pair(a: str, b: str) -> tuple[ByteTokens, PieceTokens]:
    return ByteTokens(a), PieceTokens(b)


def runs(ea: list[int], eb: list[int]) -> list[int]:
    """(i, i end, j, j end), laid end to end, of one-to-one stretches, where both lengths are equal and every pair
    ends together, and of single irregular groups. ``ea`` and ``eb`` rise and have the same last end."""
    out: list[int] = []
    i = j = 0
    n, m = len(ea), len(eb)
    while i < n:
        x, y = ea[i], eb[j]
        if x == y:
            start, first = i, j
            i, j, step = i + 1, j + 1, 2
            while i + step <= n and j + step <= m and ea[i : i + step] == eb[j : j + step]:
                i, j, step = i + step, j + step, step * 2
            while step > 1:  # the run ends within the next ``step`` ends
                step //= 2
                if i + step <= n and j + step <= m and ea[i : i + step] == eb[j : j + step]:
                    i, j = i + step, j + step
            out += (start, i, first, j)
        else:
            start, first = i, j
            while x != y:
                if x < y:
                    i += 1
                    x = ea[i]
                else:
                    j += 1
                    y = eb[j]
            i, j = i + 1, j + 1
            out += (start, i, first, j)
    return out


class Aligned:
    """Groups of one text: how many, their links, their spelling as text, and distinct pairs with how often.

    ``a`` and ``b`` are the ids, ``ea`` and ``eb`` the bytes where they end, ``signs`` the texts of ``signs_of``.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, signs: tuple[list[str], list[int]]):
        i, i2, j, j2 = np.array(runs(ea.tolist(), eb.tolist()), dtype=np.int64).reshape(-1, 4).T
        straight = (i2 - i == j2 - j) & (ea[i] == eb[j])
        held = np.where(straight, i2 - i, 1)  # groups of a run
        self.groups = int(held.sum())
        within = np.arange(self.groups) - np.repeat(np.cumsum(held) - held, held) + 1
        straight = np.repeat(straight, held)
        a_end = np.where(straight, np.repeat(i, held) + within, np.repeat(i2, held))
        b_end = np.where(straight, np.repeat(j, held) + within, np.repeat(j2, held))
        p, q = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        self.links = int((p * q).sum())

        # places of the tokens in the text of all groups: those of A, then those of B, group by group
        text, (comma_a, bar, comma_b, semicolon) = signs
        of_a, of_b = np.repeat(np.arange(self.groups), p), np.repeat(np.arange(self.groups), q)
        said = np.empty(len(a) + len(b), dtype=np.int64)
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[a_end - 1], last_b[b_end - 1] = True, True
        said[np.arange(len(a)) + (b_end - q)[of_a]] = a + np.where(last_a, bar, comma_a)
        said[np.arange(len(b)) + a_end[of_b]] = b + np.where(last_b, semicolon, comma_b)
        self.text = "".join(map(text.__getitem__, said.tolist()))[:-1]

        large = p * q > SMALL
        times = np.where(large, 0, q)[of_a]
        first = np.repeat((b_end - q)[of_a] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        flat = np.repeat(a << SHIFT, times) + b[first]
        if not large.any():
            self.pairs, self.times = np.unique(flat, return_counts=True)
            return
        parts, weights = [flat], [np.ones(len(flat), dtype=np.int64)]
        for g in np.flatnonzero(large):  # distinct ids of either side, each pair as often as both say
            ua, ka = np.unique(a[a_end[g] - p[g] : a_end[g]] << SHIFT, return_counts=True)
            ub, kb = np.unique(b[b_end[g] - q[g] : b_end[g]], return_counts=True)
            parts.append((ua[:, None] + ub[None, :]).ravel())
            weights.append((ka[:, None] * kb[None, :]).ravel())
        self.pairs, back = np.unique(np.concatenate(parts), return_inverse=True)
        self.times = np.zeros(len(self.pairs), dtype=np.int64)
        np.add.at(self.times, back, np.concatenate(weights))


def signs_of(n_a: int, n_b: int) -> tuple[list[str], list[int]]:
    """Every id of both vocabularies as text with each sign that may follow it, and where each such part starts."""
    parts = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
    starts = np.cumsum([0, *[n for n, _ in parts]])[:4].tolist()
    return [f"{i}{sign}" for n, sign in parts for i in range(n)], starts


@lru_cache(maxsize=2)
def _signs(n_a: int, n_b: int) -> tuple[list[str], list[int]]:
    return signs_of(n_a, n_b)


LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,times:long>>"
_LINK = pa.struct([("pair", pa.int64()), ("times", pa.int64())])


def _batch(rows: list[tuple], pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    cols = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:5]]
    cols.append(pa.array([r[5] for r in rows], pa.string()))
    offs = np.zeros(len(pairs) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in pairs], out=offs[1:])
    both = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (pairs, times)], fields=list(_LINK))
    cols.append(pa.ListArray.from_arrays(pa.array(offs), both))
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def _align(vocabularies: tuple[str, str]):
    none = np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizer_pair(*vocabularies)
        signs = _signs(len(first.spelling.bytes), len(second.spelling.bytes))
        for batch in batches:
            rows, pairs, times, held = [], [], [], 0
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids), 200):
                part = [t.as_py() or "" for t in texts[lo : lo + 200]]
                for doc, text, a, b in zip(ids[lo : lo + 200], part, first.encode(part), second.encode(part), strict=True):
                    want = b" " + text.encode()
                    a = np.array(a, dtype=np.int64)
                    ea = first.spelling.lengths[a].cumsum()
                    # A cuts the bytes it is given, so it spells them if nothing was passed over; B may rewrite a text
                    if not text or ea[-1] != len(want) or second.spelling.whole(b) != want:
                        rows.append((doc, 0, 0, 0, 0, ""))
                        pairs.append(none)
                        times.append(none)
                        continue
                    b = np.array(b, dtype=np.int64)
                    got = Aligned(a, b, ea, second.spelling.lengths[b].cumsum(), signs)
                    rows.append((doc, len(a), len(b), got.groups, got.links, hashlib.sha256(got.text.encode()).hexdigest()))
                    pairs.append(got.pairs)
                    times.append(got.times)
                    held += len(got.pairs)
                if held >= FLUSH:
                    yield _batch(rows, pairs, times)
                    rows, pairs, times, held = [], [], [], 0
            if rows:
                yield _batch(rows, pairs, times)

    return run


def linked_tokens(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: token, group and link counts, the groups' digest and its distinct links."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_align(vocabularies or default_vocabularies()), LINKED)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked; ``best`` where no other pair of its A id has more."""
    pairs = linked.select(F.explode("links.pair").alias("pair"))
    counts = stored(pairs.groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    tops = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("top"))
    marked = counts.join(stored(tops, "align-tops"), F.shiftright("pair", SHIFT) == F.col("a"))
    out = stored(marked.select(F.col("pair").alias("counted"), "n", (F.col("n") == F.col("top")).alias("best")), "align-marked")
    discard(counts)
    return out


def hot_limit(counts: DataFrame, pairs: int) -> int:
    """The smallest power of two such that at most ``pairs`` pairs are held by so many documents."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    have = {r["level"]: r["k"] for r in counts.groupBy(level).agg(F.count("*").alias("k")).collect()}  # 63 rows at most
    total, limit = 0, 63
    for at in range(62, -1, -1):
        total += have.get(at, 0)
        if total > pairs:
            break
        limit = at
    return 1 << limit


def aligned_documents(docs: DataFrame, *, vocabularies: tuple[str, str] | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``n_best`` counts a document's links whose pair no other pair of the same A id outnumbers corpus-wide, and
    ``count_sum`` adds up the documents of all its links. Texts that are null or empty, and such as one of
    the tokenizers does not spell out again, have no tokens: zeros, and an empty digest. Special tokens' strings
    are plain text. Repeated rows count as documents of their own and come out as often as they come in; a null
    id stays null; an empty table gives no rows; further columns are not looked at.
    """
    # numbered before it is written, so that the numbers stay the same whenever they are read
    linked = stored(linked_tokens(docs, vocabularies).withColumn("row", F.monotonically_increasing_id()), "align-links")
    counts = pair_counts(linked)
    limit = hot_limit(counts, hot_pairs)
    hot, cold = counts.filter(F.col("n") >= limit), counts.filter(F.col("n") < limit)
    links = linked.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.times")

    def sums(found: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
        return found.groupBy(F.col("row").alias("of")).agg(best.alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    # at most hot_pairs rows: counted above
    total = sums(links.join(F.broadcast(hot), F.col("pair") == F.col("counted")))
    if not cold.isEmpty():
        rest = links.join(F.broadcast(hot.select("counted")), F.col("pair") == F.col("counted"), "left_anti")
        total = total.unionByName(sums(rest.join(cold, F.col("pair") == F.col("counted"))))
        total = total.groupBy("of").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = linked.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(total, F.col("row") == F.col("of"), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )


@query("op12_diagonal_alignment")
def op12_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"))
