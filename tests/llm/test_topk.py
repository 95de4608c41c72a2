import math

import numpy as np

from burstseries.llm.topk import top_k, usable_vectors


def plain(rows, k, every):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])}
    return out


def run(df, **kw):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(usable_vectors(df), **kw).collect())


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = sorted(plain(rows, 5, 50))
    assert run(df) == want
    assert run(df, width=7, group=3) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 0.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (100, []), (8, []), (150, [1.0, 2.0, 3.0]), (9, [-1.0, -2.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, dim int, block string")
    got = run(df, width=2, group=2)
    assert (0, 1, 3, 256 * 256 * 5) in got and (0, 2, 3, 256 * 256 * 5) in got and (0, 3, 50, 256 * 256 * 5) in got
    assert (100, 1, 8, 0) in got and not [r for r in got if r[0] == 150]
    assert run(df.limit(0)) == []


def test_ties_by_id(spark):
    df = spark.createDataFrame([(i, [1.0] * 4) for i in range(120)], "vec_id long, embedding array<float>")
    got = run(df, width=16, group=2)
    assert [r[2] for r in got if r[0] == 50] == [0, 1, 2, 3, 4]
    assert [r[2] for r in got if r[0] == 0] == [1, 2, 3, 4, 5]
