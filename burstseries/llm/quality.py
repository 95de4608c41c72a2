"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's emission score is linear in its own features and those of the lines
before and after it; neighbouring labels are tied by transition weights. Forward-backward gives each line's
marginal probability of being good, and a document's quality is their mean, weighted by line length.

Features come from whole-buffer sweeps over the text bytes (shares of character classes, repeated words and
lines), never from ids, sources, languages or labels. Training labels are the documents', given to each line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.llm.common import PIECE, Words, fold, list_array, mix, prefix_sums, range_hashes, text_pieces
from burstseries.llm.registry import query, table

#: Bytes of each class; bytes over 127 count as letters.
CLASSES = {
    "upper": bytes(range(ord("A"), ord("Z") + 1)),
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "bang": b"!?",
    "other": b"\"'()[]{}-_=+/\\:;@^~`",
}
LINE_FEATURES = (*CLASSES, "word_length", "short", "again", "again2", "distinct", "dup_line", "one_word")
N = len(LINE_FEATURES)
MODEL_WIDTH = 3 * N + 1

_CLASS = np.zeros(256, dtype=np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _k + 1


def _sum(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[ends] - total[starts]).astype(np.float64)


def line_features(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, lines per row) of the lines of a piece that have a word."""
    data, words = piece.data, Words(piece)
    breaks = np.flatnonzero(data == 10) + 1
    borders = np.unique(np.concatenate([breaks, piece.offs]))
    starts, ends = borders[:-1], borders[1:]
    if not len(starts):
        return np.zeros((0, N)), np.zeros(0), np.zeros(piece.rows, dtype=np.int64)
    first = np.searchsorted(words.starts, starts)
    n_words = np.diff(np.append(first, len(words)))
    full = n_words > 0
    starts, ends, first, n_words = starts[full], ends[full], first[full], n_words[full]
    row = np.searchsorted(piece.offs, starts, side="right") - 1
    per_row = np.bincount(row, minlength=piece.rows)
    if not len(starts):
        return np.zeros((0, N)), np.zeros(0), per_row
    w = np.maximum(n_words, 1).astype(np.float64)
    size = (ends - starts).astype(np.float64)
    cls = _CLASS[data]
    cols = []
    for k, name in enumerate(CLASSES):
        got = _sum(cls == k + 1, starts, ends)
        cols.append(got / (size if name in ("upper", "digit", "other") else w))
    h = words.hashes
    line = np.repeat(np.arange(len(starts)), n_words)
    length = (words.ends - words.starts).astype(np.float64)
    last = first + n_words
    cols.append(_sum(words.ends - words.starts, first, last) / w / 10.0)
    cols.append(_sum(length <= 2, first, last) / w)
    for back in (1, 2):
        same = np.zeros(len(h), dtype=bool)
        same[back:] = (h[back:] == h[:-back]) & (line[back:] == line[:-back])
        cols.append(_sum(same, first, last) / w)
    keys = np.sort((line.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[new] >> np.uint64(36)).astype(np.int64), minlength=len(starts))
    cols.append(1.0 - distinct / np.sqrt(w * (w + 10.0)))
    text = range_hashes(prefix_sums(data), starts, np.maximum(words.ends[last - 1], starts))
    keys = mix(text ^ mix(row.astype(np.uint64)))
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    cols.append((times[inverse] > 1).astype(np.float64))
    cols.append((n_words == 1).astype(np.float64))
    return np.minimum(np.stack(cols, axis=1), 4.0), size, per_row


def with_neighbours(x: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the ends), and a constant."""
    first = np.zeros(len(x), dtype=bool)
    at = np.cumsum(per_row) - per_row
    first[at[per_row > 0]] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1]
    before[first] = 0
    after[:-1] = x[1:]
    after[:-1][first[1:]] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


@dataclass(frozen=True)
class LineField:
    """Weights of a trained field; ``prior`` is the score of a text without words."""

    weights: np.ndarray  # of the good label, over MODEL_WIDTH
    change: np.ndarray  # 2 x 2 transition scores, [from, to], 0 bad, 1 good
    prior: float


def _padded(per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all lines in a rows x longest grid."""
    row = np.repeat(np.arange(len(per_row)), per_row)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)


def forward_backward(score: np.ndarray, change: np.ndarray, per_row: np.ndarray):
    """Marginals of good per line, log partition per row and expected transitions.

    Rows are handled together, step by step along the lines; a step touches only rows that are as long.
    Lines of one row never meet those of another.
    """
    rows = len(per_row)
    order = np.argsort(-per_row, kind="stable")
    longest = int(per_row[order[0]]) if rows else 0
    first = np.cumsum(per_row) - per_row
    alive = np.searchsorted(-per_row[order], -np.arange(longest), side="left")  # rows longer than t
    e = np.stack([np.zeros_like(score), score], axis=1)
    a, b = np.zeros_like(e), np.zeros_like(e)
    for t in range(longest):
        at = first[order[: alive[t]]] + t
        if t == 0:
            a[at] = e[at]
        else:
            x = a[at - 1][:, :, None] + change[None]
            a[at] = np.logaddexp(x[:, 0], x[:, 1]) + e[at]
    pair = np.zeros((2, 2))
    z = np.zeros(rows)
    have = per_row > 0
    end = first[have] + per_row[have] - 1
    z[have] = np.logaddexp(a[end, 0], a[end, 1])
    for t in range(longest - 2, -1, -1):
        live = order[: alive[t + 1]]
        at = first[live] + t
        nxt = e[at + 1] + b[at + 1]
        x = change[None] + nxt[:, None, :]
        b[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        pair += np.exp(a[at][:, :, None] + x - z[live][:, None, None]).sum(axis=0)
    good = np.exp(np.clip(a[:, 1] + b[:, 1] - np.repeat(z, per_row), -700, 0))
    return good, z, pair


def train_field(x: np.ndarray, per_row: np.ndarray, good: np.ndarray, *, rounds: int = 200, rate: float = 0.08, decay: float = 2e-4) -> LineField:
    """Maximum likelihood with a quadratic penalty, by Adam steps; each document weighs the same."""
    prior = float((good.sum() + 1) / (len(good) + 2))
    full = with_neighbours(x, per_row)
    row = np.repeat(np.arange(len(per_row)), per_row)
    y = good[row].astype(np.float64)
    weigh = (1.0 / np.maximum(per_row, 1))[row] / max(1, int((per_row > 0).sum()))
    theta = np.zeros(MODEL_WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    same = np.zeros((2, 2))
    steps = np.maximum(per_row - 1, 0)
    same[1, 1], same[0, 0] = steps[good].sum(), steps[~good].sum()
    n_lines = max(1, len(full))
    for i in range(1, rounds + 1):
        change = theta[MODEL_WIDTH:].reshape(2, 2)
        p, _, pair = forward_backward(full @ theta[:MODEL_WIDTH], change, per_row)
        grad = np.concatenate([full.T @ ((y - p) * weigh), ((same - pair) / n_lines).ravel()])
        grad -= decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return LineField(theta[:MODEL_WIDTH], theta[MODEL_WIDTH:].reshape(2, 2), prior)


def document_scores(field: LineField, x: np.ndarray, size: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal per row; the prior where there is no line with a word or nothing was learned."""
    out = np.full(len(per_row), field.prior)
    if len(x) and (field.weights.any() or field.change.any()):
        good, _, _ = forward_backward(with_neighbours(x, per_row) @ field.weights, field.change, per_row)
        row = np.repeat(np.arange(len(per_row)), per_row)
        have = per_row > 0
        total = np.bincount(row, weights=size, minlength=len(per_row))
        out[have] = (np.bincount(row, weights=good * size, minlength=len(per_row))[have] / total[have])
    return np.clip(out, 0.0, 1.0)


def _score(field: LineField, limit: int = PIECE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch, limit=limit):
                x, size, per_row = line_features(piece)
                got = document_scores(field, x, size, per_row)
                keep = [piece.column(n) for n in batch.schema.names if n != "text"]
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(got)], [*names, "score"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_pieces(batch):
            x, _, per_row = line_features(piece)
            flat = list_array(x.astype(np.float32).ravel(), per_row * N, pa.float32())
            yield pa.RecordBatch.from_arrays([piece.column("good"), flat], ["good", "x"])


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, sample: int = 6000, longest: int = 200, rounds: int = 200
) -> LineField:
    """A field fitted on at most ``sample`` labelled documents, those with the smallest hash of their id.

    Documents of more than ``longest`` lines are left out of the fit (not of scoring), so what reaches the
    driver is at most ``sample * longest`` rows of numbers. Without labels of both kinds all scores are the
    smoothed share of good labels.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("l_id")).agg((F.min("quality") > 0).alias("good"))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "l_id"), "l_id").limit(sample)
    # at most `sample` rows of two columns
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["l_id"]).select("good", "text")
    got = rows.mapInArrow(_features, "good boolean, x array<float>").filter(F.size("x") <= longest * N).toArrow()
    good = got.column("good").to_numpy().astype(bool)
    per_row = got.column("x").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // N
    flat = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N)
    if not len(good) or good.all() or not good.any():
        return LineField(np.zeros(MODEL_WIDTH), np.zeros((2, 2)), float((good.sum() + 1) / (len(good) + 2)))
    return train_field(flat, per_row, good, rounds=rounds)


def score_quality(docs: DataFrame, field: LineField, id_column: str = "doc_id") -> DataFrame:
    """(id, score) of every row, from the text alone; narrow. Null text: scored as empty."""
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(_score(field), f"{id_column} {kind}, score double")


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = fit_quality(docs, labels.filter(fold("doc_id", 3) != 1))
    got = score_quality(docs, field)
    return got.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
