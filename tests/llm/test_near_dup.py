import random
import re

from pyspark.sql import functions as F

from burstseries.llm.near_dup import near_duplicates, representatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def plain(rows, n, share):
    sets = [(d, shingles(t, n)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= share * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


def check(df, n=3, share=85):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, n=n, share=share).collect())
    assert got == plain(rows, n, share)


def test_edited_copies_and_bridges(spark):
    """Chains of edits, so that some members of a group are linked only through others."""
    rng = random.Random(3)
    rows = []
    for g in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(160)]
        for k in range(12):
            rows.append((g * 100 + k, " ".join(words)))
            for _ in range(rng.choice((1, 3, 5))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    check(df, n=5, share=80)


def test_odd_rows(odd, none):
    check(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_duplicates(none).count() == 0


def test_one_of_each_group_stays(odd):
    got = representatives(odd)
    assert got.columns == odd.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(8) == 1 and 9 not in ids and ids.count(None) == 1 and {1, 2, 3} <= set(ids)


def test_pairs_apart_equal_enumeration(spark, monkeypatch):
    """Pairs of a key, in one cell and dealt into many, are those with the sizes, distance and bound, each under one key."""
    import numpy as np

    from burstseries.llm import near_dup as nd

    rng = np.random.default_rng(5)
    rows, base = [], rng.integers(0, 1 << nd.BITS, nd.SYMBOLS)
    for d in range(90):
        symbols = base.copy()
        other = rng.random(nd.SYMBOLS) < rng.choice([0.1, 0.3, 0.5])
        symbols[other] = rng.integers(0, 1 << nd.BITS, other.sum())
        grams = np.flatnonzero(rng.random(rng.integers(100, 140)) < rng.choice([0.8, 0.95])).astype(np.uint64)
        bits = nd.range_bits(nd.mix(grams), np.array([len(grams)]))[0]
        spare = len(grams) - int(np.bitwise_count(bits.view(np.uint64)).sum())
        chunks = [int(sum(int(v) << (nd.FIELD * p) for p, v in enumerate(symbols[4 * k : 4 * k + 4]))) for k in range(nd.CHUNKS)]
        rows.append((d, int(rng.integers(3)), len(grams), spare, chunks, bits, symbols))
    want = set()
    for x in rows:
        for y in rows:
            other = x[6] != y[6]
            both = int(np.bitwise_count((x[5] & y[5]).view(np.uint64)).sum()) + min(x[3], y[3])
            near = 100 * min(x[2], y[2]) >= 70 * max(x[2], y[2]) and 170 * both >= 70 * (x[2] + y[2])
            meet = (other.reshape(nd.CHUNKS, -1).sum(axis=1) <= 1).any()
            if x[0] < y[0] and x[1] != y[1] and other.sum() <= nd.MAX_DISTANCE and near and meet:
                want.add((x[0], y[0]))
    names = ["id", "label", "n_shingles", "spare", *nd.CHUNK_NAMES, *nd.RANGE_NAMES]
    plain = [(r[0], r[1], r[2], r[3], *r[4], *r[5].tolist()) for r in rows]
    df = spark.createDataFrame(plain, ", ".join(f"{c} long" for c in names))
    df = nd.index_keys(df).join(df, "id").withColumn("rows", F.lit(len(rows)))
    for cell in (1 << 12, 13):
        monkeypatch.setattr(nd, "CELL", cell)
        got = [(r["a"], r["b"]) for r in nd.pairs_apart(df, 70).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 100


def test_fine_bits_never_lose_a_common_shingle():
    import numpy as np

    from burstseries.llm.near_dup import fine_bits, most_common

    rng = np.random.default_rng(7)
    for _ in range(100):
        pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 500))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert both <= most_common(fine_bits(a), fine_bits(b), len(a), len(b)) <= both + 0.35 * min(len(a), len(b)) + 5
