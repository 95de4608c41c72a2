import numpy as np
import xxhash
from pyspark.sql import functions as F

from burstseries.llm.pivot_prints import block_masks, print_components, simhash_components


def plain_print(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=4):
    """(smallest member) for every place of ``prints``."""
    n = len(prints)
    p = np.array(prints, dtype=np.uint64)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(p[i + 1 :] ^ p[i]) <= distance) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = [plain_print(t) for _, t in rows]
    comp = plain_components(prints)
    # rows of one id are one document
    want = {}
    groups = {}
    for (i, _), c in zip(rows, comp, strict=True):
        groups.setdefault(c, set()).add(i)
    low = {c: min((i for i in g if i is not None), default=None) for c, g in groups.items()}
    got = simhash_components(docs).collect()
    assert len(got) == len(rows)
    for (i, _), p, c in zip(rows, prints, comp, strict=True):
        want.setdefault((i, f"{p:016x}"), low[c])
    assert {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got} == want


def test_documents_against_all_pairs(docs):
    check(docs)


def test_odd_rows(odd):
    check(odd)


def test_empty_table(none):
    assert simhash_components(none).collect() == []


def test_one_id_with_two_texts(spark):
    texts = [(1, "alpha beta gamma delta epsilon"), (7, "one two three four five six"), (7, "alpha beta gamma delta epsilon"), (9, "one two three four five six")]
    got = simhash_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 7: 1, 9: 1}


def test_blocks_cover_all_bits():
    for blocks in range(3, 12):
        masks = [m % (1 << 64) for m in block_masks(blocks)]
        assert sum(masks) == (1 << 64) - 1


def planted(seed):
    """Fingerprints at all distances from 0 to 7 of a few centres, chains, and one dense group."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    for c in out[:40]:
        for d in range(8):
            x = c
            for b in rng.choice(64, d, replace=False):
                x ^= 1 << int(b)
            out.append(x)
    step = out[0]
    for _ in range(40):
        for b in rng.choice(64, 4, replace=False):
            step ^= 1 << int(b)
        out.append(step)
    dense = out[1]
    for _ in range(500):
        x = dense
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


def test_links_against_all_pairs(spark):
    for seed, wide in ((1, 256), (2, 6)):  # a narrow limit sends most keys through the further cuts
        prints = planted(seed)
        signed = [p - (1 << 64) if p >> 63 else p for p in prints]
        df = spark.createDataFrame([(p,) for p in signed], "fp long")
        got = {r["v"]: r["label"] for r in print_components(df, wide=wide).collect()}
        order = sorted(range(len(prints)), key=lambda i: signed[i])
        comp = plain_components([prints[i] for i in order])
        want = {signed[order[i]]: signed[order[c]] for i, c in enumerate(comp)}
        assert {p: got.get(p, p) for p in signed} == want


def test_pairs_that_meet_do_not_grow_with_a_copied_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same few words in every row").alias("text"))
    assert simhash_components(docs).agg(F.countDistinct("component_id"), F.count("*")).first()[:] == (1, 3000)
