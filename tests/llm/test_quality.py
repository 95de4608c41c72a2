from itertools import product

import numpy as np
from pyspark.sql import functions as F

from burstseries.llm.common import fold
from burstseries.llm.quality import N, fit_quality, forward_backward, score_quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    per_row = np.array([3, 0, 1, 5])
    score, change = rng.normal(size=9), rng.normal(size=(2, 2))
    good, z, pair = forward_backward(score, change, per_row)
    at, want_pair = 0, np.zeros((2, 2))
    for r, n in enumerate(per_row):
        if not n:
            assert z[r] == 0
            continue
        total, marg, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            s = sum(score[at + i] * y[i] for i in range(n)) + sum(change[y[i], y[i + 1]] for i in range(n - 1))
            w = np.exp(s)
            total += w
            marg += w * np.array(y)
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += w
        assert np.allclose(good[at : at + n], marg / total) and np.isclose(z[r], np.log(total))
        want_pair += pairs / total
        at += n
    assert np.allclose(pair, want_pair)


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    field = fit_quality(docs, labels.filter(fold("doc_id", 3) != 1), rounds=120)
    got = score_quality(docs, field).join(labels.filter(fold("doc_id", 3) == 1), "doc_id").select("score", "quality").toPandas()
    pos, neg = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    accuracy = ((got.score >= 0.5) == (got.quality == 1)).mean()
    print("auc", auc, "accuracy", accuracy)
    assert auc > 0.95 and accuracy > 0.93


def test_odd_rows(spark, sf, docs, odd, none):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    field = fit_quality(docs, labels, rounds=30)
    got = score_quality(odd, field).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] == by[3] == field.prior
    assert score_quality(none, field).count() == 0
    # the same text has the same score wherever it stands
    a = {r["doc_id"]: r["score"] for r in score_quality(docs, field).collect()}
    b = {r["doc_id"]: r["score"] for r in score_quality(docs.orderBy(F.desc("doc_id")).coalesce(1), field).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    field = fit_quality(docs, none)
    assert len(field.weights) == 3 * N + 1
    assert {r["score"] for r in score_quality(docs, field).collect()} == {0.5}


def test_labels_of_one_kind(spark, docs):
    some = docs.limit(98).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    field = fit_quality(docs, some)
    assert field.prior == 0.99
    assert {r["score"] for r in score_quality(docs, field).collect()} == {0.99}
