import re

from pyspark.sql import functions as F

from burstseries.llm.mixing import mix, mixed_documents, source_targets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Share and share again what the bounded sources leave, as the rule is worded."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, open_, t = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        rate = (total - sum(t.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if rate * w[s] > 2 * sizes[s]}
        if not over:
            t |= {s: rate * w[s] for s in open_}
            break
        t |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return t


def check(docs, fan=32):
    texts = docs.select("doc_id", "text", "source").collect()
    got = mix(docs).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(r["doc_id"]) for r in texts)
    sizes, biggest = {}, {}
    for r in texts:
        n = len(WORD.findall((r["text"] or "").encode()))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        biggest[r["source"]] = max(biggest.get(r["source"], 0), n)
    targets, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    for s, t in taken.items():
        assert abs(t - targets[s]) <= biggest[s] + 1e-6
    return got


def test_targets_and_totals(docs):
    got = check(docs)
    again = mix(docs.repartition(7)).collect()
    key = lambda rows: sorted((r["id"], r["copies"]) for r in rows)
    assert key(got) == key(again)


def test_one_hot_source_over_three_levels(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', int(1 + id % 37))").alias("text"),
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"),
    )
    check(rows)


def test_odd_rows(odd):
    check(odd)
    back = mixed_documents(odd)
    assert back.columns == odd.columns
    copies = {}
    for r in mix(odd).collect():
        copies[r["id"]] = copies.get(r["id"], 0) + r["copies"]
    counts = {r["doc_id"]: r["count"] for r in back.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}


def test_expected_copies(spark):
    """Each document's expected number of copies stays its source's rate."""
    from burstseries.llm.mixing import pivotal_copies

    rows = spark.createDataFrame([(f"s{i}", i * 100 + j, 5 + j * j) for i in range(3) for j in range(6)], "source string, id long, size long")
    rows = rows.withColumn("key", F.col("id"))
    targets = source_targets(rows)
    total = {}
    for seed in range(12):
        for r in pivotal_copies(rows, targets, fan=4, seed=seed).collect():
            total[r["id"]] = total.get(r["id"], 0) + r["copies"]
    rate = {r["source"]: r["target"] / r["source_size"] for r in targets.collect()}
    for i, n in total.items():
        assert abs(n / 12 - rate[f"s{i // 100}"]) < 0.6


def test_empty(none):
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0
