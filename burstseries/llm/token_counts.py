"""Token counts of sections and fields by offset-mapped attribution.

A document is encoded once as a whole, since cutting it first would change its tokens. The tokens' byte
spans, from the lengths of their byte strings, are then joined with the spans of the sections (sorted
intervals on both sides, so the join is a binary search per token). A token that reaches over a border goes by
the rule named:

- ``first``: to the section its first byte is in;
- ``last``: to the section its last byte is in;
- ``most``: to the section that holds most of its bytes, the earlier one of equals.

Whatever the rule, the counts of a document's sections add up to its number of tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.llm.bpe import ByteBpe, byte_bpe, default_vocabulary
from burstseries.llm.registry import query, table

RULES = ("first", "last", "most")


def attribute(lengths: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) per section.

    ``lengths``: bytes of each token; ``starts``: where the sections start, from 0 on, rising (an empty
    section starts where the next does and gets nothing). A token over a border counts as crossing for
    every section it touches.
    """
    n = len(starts)
    ends = np.cumsum(lengths)
    begin = ends - lengths
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    over = np.flatnonzero(first != last)
    owner = last if rule == "last" else first
    if rule == "most" and len(over):
        owner = first.copy()
        borders = np.append(starts, ends[-1])
        for t in over:
            touched = np.arange(first[t], last[t] + 1)
            held = np.minimum(borders[touched + 1], ends[t]) - np.maximum(borders[touched], begin[t])
            owner[t] = touched[np.argmax(held)]
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, first[over], 1)
    np.add.at(change, last[over] + 1, -1)
    return np.bincount(owner, minlength=n), np.cumsum(change)[:n]


def line_starts(data: np.ndarray) -> np.ndarray:
    """Sections are lines; a line break belongs to the line it ends, and none starts after the last one."""
    starts = np.append(0, np.flatnonzero(data == 10) + 1)
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(data) else starts


def _chars(data: np.ndarray) -> np.ndarray:
    """Characters before each byte place."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def _sections(vocabulary, rule: str, id_column: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*vocabulary)
        for batch in batches:
            ids, texts = batch.column(id_column), batch.column("text")
            for lo in range(0, batch.num_rows, 500):
                row, cols = [], [[] for _ in range(5)]
                for i in range(lo, min(lo + 500, batch.num_rows)):
                    text = texts[i].as_py() or ""
                    data = np.frombuffer(text.encode(), dtype=np.uint8)
                    starts = line_starts(data)
                    counts, crossing = count_tokens(bpe, text, starts, rule)
                    chars = _chars(data)
                    ends = np.append(starts[1:], len(data))
                    row.append(np.full(len(starts), i))
                    parts = (np.arange(len(starts)), chars[starts], chars[ends] - chars[starts], counts, crossing)
                    for c, x in zip(cols, parts, strict=True):
                        c.append(x)
                out = [ids.take(pa.array(np.concatenate(row)))]
                out += [pa.array(np.concatenate(c), pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(cols)]
                names = [id_column, "section", "start_char", "n_chars", "n_tokens", "n_crossing"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def count_tokens(bpe: ByteBpe, text: str, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    got = bpe.ids(text)
    if not len(got):
        return np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    return attribute(bpe.lengths[got], starts, rule)


def section_token_counts(
    docs: DataFrame, *, rule: str = "first", vocabulary: tuple[str, str] | None = None, id_column: str = "doc_id"
) -> DataFrame:
    """One row per document and line: place, characters, tokens, tokens that reach over one of its borders.

    Narrow. A null or empty text is one empty section without tokens; repeated rows and null ids are
    counted like any other; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, section int, start_char long, n_chars long, n_tokens long, n_crossing long"
    run = _sections(vocabulary or default_vocabulary(), rule, id_column)
    return docs.select(id_column, "text").mapInArrow(run, schema)


def _fields(vocabulary, fields: Sequence[str], rule: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*vocabulary)
        for batch in batches:
            joined = batch.column("__text")
            starts = np.stack([batch.column(f"__at_{f}").to_numpy() for f in fields], axis=1)
            keep = batch.schema.names[: -1 - len(fields)]
            counts = np.zeros((batch.num_rows, len(fields)), dtype=np.int64)
            for i in range(batch.num_rows):
                counts[i] = count_tokens(bpe, joined[i].as_py(), starts[i], rule)[0]
            cols = [batch.column(k) for k in keep] + [pa.array(counts[:, j]) for j in range(len(fields))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *[f"{f}_tokens" for f in fields]])

    return run


def field_token_counts(
    df: DataFrame,
    keep: Sequence[str],
    fields: Sequence[str],
    *,
    sep: str = "\n",
    rule: str = "first",
    vocabulary: tuple[str, str] | None = None,
) -> DataFrame:
    """``keep`` and ``<field>_tokens`` of each text field, encoded as one text joined by ``sep``.

    The separator belongs to the field before it; null fields are empty.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, places = F.lit(0).cast("long"), []
    for f, p in zip(fields, parts, strict=True):
        places.append(at.alias(f"__at_{f}"))
        at = at + F.octet_length(p) + F.lit(len(sep.encode()))
    src = df.select(*keep, *places, F.concat_ws(sep, *parts).alias("__text"))
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep] + [f"`{f}_tokens` long" for f in fields])
    return src.mapInArrow(_fields(vocabulary or default_vocabulary(), fields, rule), schema)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents"))
