import hashlib

import pytest
from pyspark.sql import functions as F

from burstseries.llm import suffix_dedup
from burstseries.llm.suffix_dedup import exact_dedup


def plain(rows, size=50):
    """Every string of every smaller document, position by position."""
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1 if d is not None else 0):
            if first[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        spans = sum(x and (i == 0 or not gone[i - 1]) for i, x in enumerate(gone))
        rest = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def check(df):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in exact_dedup(df).collect())
    assert got == plain([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("hot", [5000, 1])
def test_equal_to_brute_force(docs, monkeypatch, hot):
    """Also where every shared anchor name goes through single windows."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    check(docs)


def test_odd_rows(odd, none):
    tail = "shared tail that is long enough to be found as a repeated passage in both"
    more = odd.select("doc_id", "text").filter("doc_id is null or doc_id <> 6").unionByName(
        odd.sparkSession.createDataFrame(
            [(20, "a" * 300), (21, "a" * 120 + "b"), (22, "é" * 70), (23, "é" * 70 + "x"), (24, "head one " + tail), (25, tail + " end")],
            "doc_id long, text string",
        )
    )
    check(more.withColumn("name", F.lit("x")))
    assert exact_dedup(none).count() == 0


def test_kept_bytes(docs):
    got = exact_dedup(docs, with_text=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
