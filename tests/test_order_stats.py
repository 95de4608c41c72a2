"""Exact order statistics and ranks with one group that holds nearly all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstseries.functions.ranges import dense_ranks, value_ranges
from burstseries.operators.flows import rank_ports
from burstseries.operators.order_stats import column_medians, grouped_percentiles, running_counts

LEVELS = [0.0, 0.1, 0.37, 0.5, 0.9, 0.999, 1.0]


def skewed(kind: str, n: int = 6000):
    rng = np.random.default_rng(5)
    draw = {
        "spread": lambda k: rng.lognormal(0, 20, k),
        "few": lambda k: rng.integers(0, 4, k).astype(float),
        "signed": lambda k: np.concatenate([-np.exp(rng.normal(0, 30, k // 2)), np.exp(rng.normal(0, 30, k - k // 2))]),
    }[kind]
    groups = np.where(rng.random(n) < 0.9, "hot", rng.choice(["a", "b", "c"], n))
    return groups, draw(n)


@pytest.mark.parametrize("kind", ["spread", "few", "signed"])
def test_percentiles_of_a_hot_group(spark, kind):
    groups, values = skewed(kind)
    rows = [(str(g), float(v)) for g, v in zip(groups, values, strict=True)] + [("none", None), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: (r["percentiles"], r["n"]) for r in grouped_percentiles(df, ["g"], "v", LEVELS, limit=50).collect()}
    assert set(got) == {"hot", "a", "b", "c", "none", None}
    assert got["none"] == (None, 0) and got[None] == ([2.0] * len(LEVELS), 1)
    for g in ("hot", "a", "b", "c"):
        want = np.percentile(values[groups == g], [100 * q for q in LEVELS])
        assert np.allclose(got[g][0], want, rtol=1e-9) and got[g][1] == (groups == g).sum()


def test_percentiles_without_groups(spark):
    df = spark.range(0, 5001).select((F.col("id") * 2.0).alias("v"))
    assert grouped_percentiles(df, [], "v", [0.5, 0.25], limit=20).first()[:] == ([5000.0, 2500.0], 5001)
    assert grouped_percentiles(df.filter("v < 0"), [], "v", [0.5]).collect()[0][:] == (None, 0)


def test_no_value_buffer_of_a_group_in_the_plan(spark):
    df = spark.range(0, 20_000).select(F.lit("hot").alias("g"), F.rand(3).alias("v"))
    rounds = grouped_percentiles(df, ["g"], "v", [0.5], limit=100)
    plan = rounds._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile(" not in plan and "median(" not in plan
    assert rounds.first()["n"] == 20_000


def test_column_medians(spark):
    rows = [(float(i), None if i % 3 else float(-i), float("nan") if i == 4 else float(i % 5)) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = column_medians(df, {"x": "a", "y": "b", "z": "c", "x2": "a"}, limit=10).first()
    c = [r[2] for r in rows if r[2] == r[2]]
    assert got[:] == (50.0, float(np.median([r[1] for r in rows if r[1] is not None])), float(np.median(c)), 50.0)


def test_ranges_are_bounded(spark):
    df = spark.range(0, 9000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("k"), F.exp(F.col("id") / 20).alias("v"))
    got = value_ranges(df, ["k"], "v", out="r", width=100)
    sizes = got.groupBy("k", "r").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    assert max(s["n"] for s in sizes) <= 100
    by = {}
    for s in sizes:
        by.setdefault(s["k"], []).append((s["r"], s["lo"], s["hi"]))
    for parts in by.values():
        parts.sort()
        assert all(a[2] < b[1] for a, b in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("width", [3, 40, 10_000])
def test_dense_ranks_of_a_hot_key(spark, width):
    groups, values = skewed("spread", 1500)
    values = np.round(values, 3)
    pairs = sorted({(str(g), float(v)) for g, v in zip(groups, values, strict=True)} | {("hot", None), (None, 1.0)}, key=str)
    got = dense_ranks(spark.createDataFrame(pairs, "k string, v double"), ["k"], "v", out="rank", descending=True, width=width)
    have = {(r["k"], r["v"]): r["rank"] for r in got.collect()}
    want = {}
    for k in {p[0] for p in pairs}:
        mine = sorted((v for g, v in pairs if g == k and v is not None), reverse=True)
        want.update({(k, v): i + 1 for i, v in enumerate(mine)})
        if (k, None) in pairs:
            want[k, None] = len(mine) + 1
    assert have == want


def test_port_ranks_with_one_address_holding_nearly_all(spark):
    rows = [(i, "hot" if i % 10 else f"ip{i % 3}", i % 50, (i * 37) % 400, (i * 11) % 90, "s") for i in range(2000)]
    df = spark.createDataFrame(rows, "window_start long, ip string, service_port long, total_inbound_bytes long, total_outbound_bytes long, source_file string")
    for how in ("row", "port_total"):
        a = sorted(map(tuple, rank_ports(df, how, width=20).collect()))
        b = sorted(map(tuple, rank_ports(df, how).collect()))
        assert a == b
    by = {}
    for _, ip, _, x, y, _ in rows:
        by.setdefault(ip, set()).add(x + y)
    rank = {(ip, b): i + 1 for ip, s in by.items() for i, b in enumerate(sorted(s, reverse=True))}
    got = sorted((r["window_start"], r["service_port"]) for r in rank_ports(df, width=20).collect())
    assert got == sorted((w, rank[ip, x + y]) for w, ip, _, x, y, _ in rows)


def test_running_counts(spark):
    rows = [("g", float(i % 13)) for i in range(400)] + [("h", 1.0)]
    got = running_counts(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", width=4).collect()
    assert {r["total"] for r in got if r["g"] == "g"} == {400}
    for r in got:
        assert r["upto"] == sum(1 for g, v in rows if g == r["g"] and v <= r["v"])


def test_similarity_with_every_pattern_of_gaps(spark):
    import pandas as pd

    from burstseries.operators.gram import feature_similarity

    rng = np.random.default_rng(8)
    n, d, m = 400, 4, 5
    x, y = rng.normal(50, 3, (n, d)), rng.normal(-20, 2, (n, m))
    y[:, 0] += x[:, 1]
    for k, share in enumerate((0.0, 0.1, 0.5, 0.97)):
        y[rng.random(n) < share, k] = np.nan
    y[:, 4] = 3.0
    group = np.where(rng.random(n) < 0.9, 1, rng.integers(2, 4, n))
    xs, ys = [f"x{i}" for i in range(d)], [f"y{k}" for k in range(m)]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([group, x, y]), columns=["g", *xs, *ys]).astype({"g": int})).repartition(6)

    def plain(rows, k):
        keep = rows & ~np.isnan(y[:, k])
        a, b = x[keep] - x[keep].mean(axis=0), y[keep, k] - y[keep, k].mean()
        under = np.sqrt(((a.T @ a) ** 2).sum()) * (b @ b)
        return keep.sum(), ((a.T @ b) ** 2).sum() / under if under > 1e-9 else 0.0

    for by in ([], ["g"]):
        got = {(*[r[g] for g in by], r["feature"]): (r["n"], r["cka_to_embedding"]) for r in feature_similarity(df, xs, ys, by).collect()}
        want = {}
        for key in [()] if not by else [(int(g),) for g in np.unique(group)]:
            rows = group == key[0] if key else np.ones(n, dtype=bool)
            for k in range(m):
                count, score = plain(rows, k)
                if count:
                    want[(*key, ys[k])] = (count, score)
        assert set(got) == set(want)
        for key, (count, score) in want.items():
            assert got[key][0] == count and abs(got[key][1] - score) < 1e-8, key


def test_partial_sums_do_not_grow_with_the_rows(spark):
    from burstseries.operators.gram import packed_sums

    rows = spark.range(20_000).select((F.col("id") % 3).alias("__gid"), F.array(F.rand(1), F.rand(2)).alias("x")).repartition(4)
    got = packed_sums(rows, 2).collect()
    assert len(got) == 3 and all(len(r["cells"]) == 3 for r in got)


def test_stored_sketches_of_days_merge(spark):
    """Sketches per day, merged for a range of days, against the values; a key with 90 % of the rows and one with none."""
    from burstseries.operators import quantiles as Q

    rng = np.random.default_rng(21)
    rows = [("hot" if rng.random() < 0.9 else "small", int(rng.integers(0, 30)), float(v)) for v in rng.lognormal(0, 3, 20_000)] + [("none", 3, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    days = Q.value_sketches(df, ["g", "day"], "v")
    some = Q.merged_sketches(days.filter("day < 10"), ["g"])
    table = Q.sketch_quantiles(some, [0.01, 0.5, 0.9, 0.999])
    errors = Q.rank_errors(table, df.filter("day < 10"), ["g"], "v").collect()
    assert len(errors) == 8 and max(r["error"] for r in errors) < 0.01
    for g in ("hot", "small"):
        assert {r["n"] for r in errors if r["g"] == g} == {sum(1 for a, d, v in rows if a == g and d < 10)}
    none = [r for r in table.collect() if r["g"] == "none"][0]
    assert none["n"] == 0 and none["quantiles"] == [None] * 4


def test_percentiles_store_counts_of_equal_values(spark, monkeypatch):
    """Rounds read one row per distinct value, not one per row; repeats weigh as often as they occur."""
    import numpy as np

    from burstseries.operators import order_stats as O

    stored = {}
    keep = O.cut_lineage

    def noted(df, name="cut"):
        out = keep(df, name)
        stored.setdefault(name, out.count())
        return out

    monkeypatch.setattr(O, "cut_lineage", noted)
    values = [0.0] * 5000 + [float(i % 40) for i in range(1000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), (None, 2.5)], "g string, v double")
    levels = [0.0, 0.5, 0.9, 0.95, 1.0]
    got = {r["g"]: (r["percentiles"], r["n"]) for r in O.grouped_percentiles(df, ["g"], "v", levels, limit=8).collect()}
    assert got["a"] == (np.percentile(values, [100 * q for q in levels]).tolist(), 6000)
    assert got["b"] == (None, 0) and got[None] == ([2.5] * 5, 1)
    assert stored["select-values"] == 42
