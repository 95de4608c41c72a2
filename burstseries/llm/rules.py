"""Quality rules: base figures of a text, and decision lists learned from labels; DataFrame functions only.

Sequential covering learns ordered rules, each a conjunction of thresholds that tells bad documents: a rule
is grown on one part of the labelled rows (condition by condition, by information gain), pruned on another
part, accepted if it is precise there, and what it covers is set aside before the next is grown. Only counts
per feature, threshold bucket and label reach the driver. The verdict is one ordered Spark condition.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstseries.functions.arrays import let
from burstseries.llm.common import WORD, stored
from burstseries.llm.registry import query, table

SYMBOLS = r"[^#*$%&|<>]"
WINDOW = 8

#: Features of the rules: figures per word, line or character, so that length alone decides nothing.
FEATURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "upper_rate", "bang_rate", "distinct_rate")


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from the hashes of all windows.

    Sorting (hash, place) puts equal windows side by side; the places of those, in order, cover eight
    words each, less what the window before already covers.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before, after = F.get(p, i - 1)["h"], F.get(p, i + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(p, twice), lambda x: x["i"]))

    def covered(q: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            q,
            start,
            lambda a, x: F.struct(
                x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"]).cast("long")).alias("n")
            ),
            lambda a: a["n"],
        )

    return let(placed, lambda p: covered(places(p)))


def base_figures(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` plus the base figures and the features; a null text counts as empty.

    Narrow: no shuffle. The costly count of repeated words runs only where two windows have one hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        *keep,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("__lines"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("__upper"),
        F.length(F.regexp_replace(text, "[^!]+", "")).alias("__bang"),
    )
    n = F.size("__words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = df.select(
        *keep, "word_chars", "n_symbols", "__upper", "__bang",
        n.cast("long").alias("n_words"),
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__words")).alias("__distinct"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i, WINDOW))).alias("__windows"),
    )
    no_repeat = F.size(F.array_distinct("__windows")) == F.size("__windows")
    df = df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "__upper", "__bang", "__n_lines", "__distinct",
        F.when(no_repeat, F.lit(0).cast("long")).otherwise(_repeated_words(F.col("__windows"))).alias("n_repeat_words"),
    )
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rates = {
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "upper_rate": F.col("__upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bang_rate": F.col("__bang") / words,
        # distinct words fall with length by themselves, so they are compared with the square root
        "distinct_rate": F.col("__distinct") / F.sqrt(words) / F.sqrt(F.lit(10.0) + words),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *[v.cast("double").alias(k) for k, v in rates.items()], failed.alias("base_failed"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def rule_column(rule: Rule) -> Column:
    out = rule[0].column()
    for c in rule[1:]:
        out = out & c.column()
    return out


def verdict(rules: Sequence[Rule]) -> Column:
    """True (keep) unless a rule applies, as one ordered condition; ``rule`` numbers count from 0."""
    out = None
    for r in rules:
        out = F.when(rule_column(r), F.lit(False)) if out is None else out.when(rule_column(r), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _counts(rows: DataFrame, grids: Mapping[str, Sequence[float]]) -> dict[tuple[str, int], list[int]]:
    """[bad, good] rows per feature and bucket; bucket i holds values above i thresholds."""
    items = F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f"__b_{f}").alias("b")) for f in grids
    ])
    got = rows.select("bad", F.explode(items).alias("x")).groupBy("x.f", "x.b").agg(
        F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")
    )
    return {(r["f"], r["b"]): [r["bad"], r["n"] - r["bad"]] for r in got.collect()}


def _best_condition(counts, grids, floor: int) -> tuple[Condition | None, int, int]:
    """The condition with most information gain over the rows counted."""
    best, gain_best = None, 0.0
    bad_best = good_best = 0
    for f, grid in grids.items():
        cells = [counts.get((f, b), [0, 0]) for b in range(len(grid) + 1)]
        all_bad, all_good = sum(c[0] for c in cells), sum(c[1] for c in cells)
        if not all_bad:
            continue
        was = math.log2((all_bad + 1) / (all_bad + all_good + 2))
        low_bad = low_good = 0
        for i, t in enumerate(grid):
            low_bad, low_good = low_bad + cells[i][0], low_good + cells[i][1]
            for above, bad, good in ((False, low_bad, low_good), (True, all_bad - low_bad, all_good - low_good)):
                if bad < floor:
                    continue
                gain = bad * (math.log2((bad + 1) / (bad + good + 2)) - was)
                if gain > gain_best + 1e-9:
                    best, gain_best, bad_best, good_best = Condition(f, above, float(t)), gain, bad, good
    return best, bad_best, good_best


def learn_rules(
    rows: DataFrame,
    *,
    features: Sequence[str] = FEATURES,
    steps: int = 24,
    longest: int = 3,
    most_rules: int = 12,
    precision: float = 0.95,
    floor: int = 5,
) -> list[Rule]:
    """Ordered rules that find bad rows. ``rows``: features, ``bad`` boolean, ``grow`` boolean (else prune).

    Thresholds are the features' quantiles among bad and among good rows (``steps`` each, and the tails). A rule is
    accepted if at least ``floor`` bad rows of the pruning part meet it and its corrected share of bad
    rows there is ``precision`` or more; learning ends with the first rule that is not. Without labelled
    rows of both kinds there are no rules.
    """
    at = sorted([(i + 0.5) / steps for i in range(steps)] + [0.0, 0.001, 0.01, 0.99, 0.999, 1.0])
    picked = rows.groupBy("bad").agg(*[F.percentile_approx(f, at, 2000).alias(f) for f in features]).collect()
    if {r["bad"] for r in picked} != {True, False}:
        return []
    grids = {f: sorted({float(v) for r in picked for v in (r[f] or []) if v is not None}) for f in features}

    def bucket(f: str) -> Column:
        grid = F.array(*[F.lit(t) for t in grids[f]])
        return F.size(F.filter(grid, lambda t: F.col(f) > t)).alias(f"__b_{f}")

    rows = stored(rows.select("bad", "grow", *features, *[bucket(f) for f in features]), "rule-rows")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.filter(verdict(rules)) if rules else rows
        grow = left.filter("grow")
        rule: Rule = ()
        while len(rule) < longest:
            seen = grow.filter(rule_column(rule)) if rule else grow
            cond, bad, good = _best_condition(_counts(seen, grids), grids, floor)
            if cond is None:
                break
            rule += (cond,)
            if good == 0:
                break
        if not rule:
            break
        heads = [rule[: i + 1] for i in range(len(rule))]
        sums = []
        for i, r in enumerate(heads):
            hit = rule_column(r)
            sums += [F.sum((hit & F.col("bad")).cast("long")).alias(f"b{i}"), F.sum(hit.cast("long")).alias(f"n{i}")]
        got = left.filter("not grow").agg(*sums).first()
        scored = []
        for i in range(len(heads)):
            bad, n = got[f"b{i}"] or 0, got[f"n{i}"] or 0
            share = (bad + 1) / (n + 2)
            if bad >= floor and share >= precision:
                scored.append((bad - (n - bad), -i, heads[i]))
        if not scored:
            break
        rules.append(max(scored)[2])
    return rules


def bad_labels(labels: DataFrame) -> DataFrame:
    """One row per document: bad if any of its labels says quality 0; null labels and ids are left out."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").alias("l_id")).agg((F.min("quality") == 0).alias("bad"))


def training_rows(figures: DataFrame, labels: DataFrame) -> DataFrame:
    lab = bad_labels(labels)
    rows = figures.join(lab, figures["doc_id"] == lab["l_id"])
    grow = F.crc32(F.concat(F.lit("grow"), F.col("doc_id").cast("string")).cast("binary")) % 3 != 0
    # what the base rule rejects anyway teaches nothing
    return rows.filter(~F.col("base_failed")).select("bad", grow.alias("grow"), *FEATURES)


def judge(figures: DataFrame, labels: DataFrame, **kw) -> tuple[DataFrame, list[Rule]]:
    """``figures`` with ``kept``: false where the base rule or a learned rule rejects."""
    rules = learn_rules(training_rows(figures, labels), **kw)
    return figures.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def kept_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The documents the rules keep, all columns as they were.

    The figures are stored beside the documents, so texts are looked at once and never shuffled.
    """
    cols = docs.columns
    packed = docs.select(F.struct(*cols).alias("__doc"), "doc_id", "text")
    rows = stored(base_figures(packed, ("__doc", "doc_id")), "rule-documents")
    rules = learn_rules(training_rows(rows.drop("__doc"), labels), **kw)
    return rows.filter(~F.col("base_failed") & verdict(rules)).select("__doc.*")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = stored(base_figures(table(spark, sf_dir, "documents")), "rule-figures")
    got, _ = judge(figures, table(spark, sf_dir, "labels"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
