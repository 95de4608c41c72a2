import math
import re
from collections import Counter

import numpy as np
import pytest

from burstseries.llm.max_sketch import Queries, Sketches, ranked_search, term_hashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k=10):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, n_terms = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, want in asked.items():
        scores = []
        for doc, c in tf:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = 0
            for t in want:
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out |= {(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k])}
    return out


def check(docs, items, **kw):
    rows = [[tuple(r) for r in x.select(c, "text").collect()] for x, c in ((docs, "doc_id"), (items, "item_id"))]
    got = [tuple(r) for r in ranked_search(docs, items, **kw).collect()]
    assert set(got) == plain(*rows, k=kw.get("k", 10))
    assert len(got) == len(set((r[0], r[1]) for r in got))


def test_documents_against_all_scores(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    check(docs, items)
    check(docs, items.limit(7), k=3, block_bytes=300)  # several blocks of queries


def test_odd_rows(spark, odd):
    items = spark.createDataFrame(
        [(1, "same TEXT here"), (2, None), (3, ""), (4, "Ünïcode wörds ok"), (5, "w1x1 w2x2 end of it"), (None, "one two"), (6, "!?"), (1, "again"),
         (7, "nothing_like_this zzz"), (5, "w1x1"), (8, "x" * 5000)], "item_id long, text string")
    check(odd, items)
    check(odd.unionByName(odd), items, k=3)


def test_empty_tables(spark, docs, none, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert ranked_search(none, items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(40, 0, -1)] + [(0, "d")], "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert [(r["rank"], r["doc_id"]) for r in ranked_search(docs, items, k=4).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bounds_are_never_below_scores(seed):
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.5, rng.integers(0, 300)) % 500) for _ in range(40)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    h, row = term_hashes(data, offs)
    assert len(h) == sum(len(t.split()) for t in texts)
    index = Sketches(h, row, len(texts), 40, len(h))
    queries = Queries([(i, [f"t{x}" for x in rng.integers(0, 500, 30)]) for i in range(20)])
    weights = rng.integers(1, 5000, len(queries.hashes))
    bound = index.bounds(queries, weights, 0, len(texts))
    spans = np.append(queries.first, len(queries.term))
    for d in range(len(texts)):
        if texts[d]:
            for q in range(len(queries.ids)):
                assert bound[d, q] >= index.score(d, queries.term[spans[q] : spans[q + 1]], queries, weights)
