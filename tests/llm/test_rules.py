import re
from collections import Counter

from pyspark.sql import functions as F

from burstseries.llm.common import stored
from burstseries.llm.rules import base_figures, judge, kept_documents, learn_rules, verdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def check(df):
    for r, t in zip(base_figures(df, ("doc_id", "text")).collect(), df.select("text").collect(), strict=True):
        assert r["text"] == t["text"]
        want = plain(r["text"])
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_base_figures(docs, odd):
    check(docs.coalesce(1))
    check(odd.coalesce(1))


def test_rules_find_what_is_planted(spark):
    rows = spark.range(3000).select(
        ((F.col("id") % 10 < 2)).alias("bad"), (F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 0).alias("grow"),
        F.when(F.col("id") % 10 == 0, 0.8).otherwise(F.rand(1) * 0.3).alias("symbol_rate"),
        F.when(F.col("id") % 10 == 1, 0.9).otherwise(F.rand(2) * 0.5).alias("upper_rate"),
    )
    rules = learn_rules(rows, features=("symbol_rate", "upper_rate"))
    got = rows.groupBy("bad", verdict(rules).alias("kept")).count().collect()
    assert {(r["bad"], r["kept"]) for r in got} == {(True, False), (False, True)}
    assert 2 <= len(rules) <= 4


def test_labels_of_one_kind_or_none(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    got, rules = judge(stored(base_figures(docs), "figures"), labels)
    assert rules == [] and got.filter(F.col("kept") == F.col("base_failed")).count() == 0
    got, rules = judge(stored(base_figures(none), "figures"), labels.limit(0))
    assert rules == [] and got.count() == 0


def test_kept_documents(spark, sf, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = kept_documents(odd, labels)
    assert got.columns == odd.columns
    assert {r["doc_id"] for r in got.collect()} <= {6, 7, 11, 12, 13, None}


def test_held_out_documents(spark, sf, docs):
    """Learned on two thirds of the labels, the verdict holds on the others."""
    big = sf.replace("sf0.001", "sf0.1")
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    d = d.join(labels.select("doc_id"), "doc_id")
    held = F.col("doc_id") % 3 == 0
    got, rules = judge(stored(base_figures(d), "figures"), labels.filter(~held))
    assert rules
    test = got.join(labels.filter(held), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in test}
    good, bad = n.get((1, True), 0), n.get((0, False), 0)
    assert good / (good + n.get((1, False), 0)) > 0.9
    assert bad / (bad + n.get((0, True), 0)) > 0.7
