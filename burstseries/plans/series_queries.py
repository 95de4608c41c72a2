"""Queries over dense series, bursts, splits, quantiles and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstseries.functions.arrays import item_rows
from burstseries.operators import bursts as B
from burstseries.operators import dense as D
from burstseries.operators import quantiles as Q
from burstseries.operators import splits as S
from burstseries.operators import tokens as T
from burstseries.plans import inputs as src
from burstseries.plans.registry import query
from burstseries.plans.traffic import PINGS, ping_samples
from burstseries.session import cut_lineage

# ---- dense series -------------------------------------------------------------------------


def _both_long(df):
    zipped = F.arrays_zip("inbound", "outbound")
    return item_rows(df, ["user_id"], zipped, "i", "z").select(
        "user_id", F.col("i").cast("long").alias("i"), F.col("z.inbound").alias("vin"), F.col("z.outbound").alias("vout")
    )


@query(
    "dense_series_span",
    f"WITH {src.SERIES} SELECT user_id, i, vin::DOUBLE AS vin, vout::DOUBLE AS vout FROM series",
)
def dense_series_span(spark, sf):
    return _both_long(src.series(spark, sf))


@query(
    "dense_series_kept",
    f"""WITH {src.SERIES}
    SELECT user_id, i, CASE WHEN i < k_in THEN vin::DOUBLE END AS vin, CASE WHEN i < k_out THEN vout::DOUBLE END AS vout
    FROM series WHERE i < greatest(k_in, k_out)""",
)
def dense_series_kept(spark, sf):
    return _both_long(src.series(spark, sf, truncate="kept"))


@query(
    "dense_one_direction",
    f"""WITH {src.EVENTS},
    h AS (SELECT event_type, second // 21600 AS bin, CAST(sum(cents) AS BIGINT) AS v FROM ev GROUP BY ALL),
    s AS (SELECT event_type, min(bin) AS b0, unnest(range(min(bin), max(bin) + 1)) AS b FROM h GROUP BY event_type)
    SELECT s.event_type, s.b - s.b0 AS i, CASE WHEN h.v >= 1000 THEN h.v ELSE 0 END::DOUBLE AS inbound, 0.0::DOUBLE AS outbound
    FROM s LEFT JOIN h ON h.event_type = s.event_type AND h.bin = s.b""",
)
def dense_one_direction(spark, sf):
    ev = src.events(spark, sf, "event_type", "second", "cents")
    bins = ev.groupBy("event_type", F.floor(F.col("second") / 21_600).cast("long").alias("bin")).agg(
        F.sum("cents").alias("v")
    )
    whole = D.dense_series(
        bins, ["event_type"], {"inbound": "v"}, threshold=1000, min_len=1, item_type="double"
    )
    both = D.one_direction(whole)
    zipped = F.arrays_zip("inbound", "outbound")
    return item_rows(both, ["event_type"], zipped, "i", "z").select(
        "event_type", F.col("i").cast("long").alias("i"), F.col("z.inbound").alias("inbound"),
        F.col("z.outbound").alias("outbound"),
    )


PING_BINS = PINGS + """,
pb AS (SELECT label, second // 10800 AS bin, avg(latency_ms) AS m FROM pings GROUP BY ALL)"""

PING_DENSE = PING_BINS + """,
ps AS (SELECT label, min(bin) AS b0, unnest(range(min(bin), max(bin) + 1)) AS b FROM pb GROUP BY label),
pd AS (
  SELECT s.label, s.b AS bin, s.b - s.b0 AS i,
         CASE WHEN p.m >= 20 THEN CAST(p.m AS FLOAT) ELSE CAST(0 AS FLOAT) END AS v,
         count(*) OVER (PARTITION BY s.label) AS n
  FROM ps s LEFT JOIN pb p ON p.label = s.label AND p.bin = s.b),
pe AS (
  SELECT label, CAST(i // 50 AS INTEGER) AS chunk_idx, i % 50 AS pos, bin, v FROM pd
  WHERE i < n // 50 * 50 AND label IN (SELECT label FROM pd GROUP BY label HAVING count(*) FILTER (WHERE v > 0) >= 5))"""


def _ping_chunks(spark, sf, store_bins=True):
    means = D.mean_bins(ping_samples(spark, sf), ["label"], "second", "latency_ms", 10_800)
    return D.mean_series_chunks(
        means, ["label"], threshold=20.0, min_len=5, seq_len=50, store_bins=store_bins
    )


@query(
    "ping_chunks",
    f"""WITH {PING_DENSE} SELECT label || '_' || chunk_idx AS example_id, label, chunk_idx, pos, bin,
    round(CAST(v AS DOUBLE), 3) AS v, min(bin) OVER (PARTITION BY label, chunk_idx) AS first_bin FROM pe""",
)
def ping_chunks(spark, sf):
    ids = ["example_id", "label", "chunk_idx", "first_bin"]
    rows = item_rows(_ping_chunks(spark, sf), ids, F.arrays_zip("inbound", "bins"), item="z")
    return rows.select(
        "example_id", "label", "chunk_idx", "first_bin", F.col("pos").cast("long").alias("pos"),
        F.col("z.bins").alias("bin"), F.round(F.col("z.inbound").cast("double"), 3).alias("v"),
    )


@query(
    "chunk_bursts",
    f"""WITH {PING_DENSE},
    a AS (SELECT *, coalesce(bin - lag(bin) OVER w, 0) AS ibg, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY label, chunk_idx) AS c
          FROM pe WHERE v >= 20 WINDOW w AS (PARTITION BY label, chunk_idx ORDER BY bin))
    SELECT label, chunk_idx, k AS pos, bin, round(CAST(v AS DOUBLE), 3) AS bi, ibg * 10800 AS ibg,
           min(bin) OVER (PARTITION BY label, chunk_idx) AS first_bin FROM a WHERE c >= 3""",
)
def chunk_bursts(spark, sf):
    chunks = _ping_chunks(spark, sf)
    got = B.bursts_from_chunks(chunks, ["label", "chunk_idx"], threshold=20.0, min_len=3, unit=10_800, keep_bins=True)
    zipped = F.arrays_zip("bi", "ibg", "active_bins")
    return item_rows(got, ["label", "chunk_idx", "first_bin"], zipped, item="z").select(
        "label", "chunk_idx", "first_bin", F.col("pos").cast("long").alias("pos"), F.col("z.active_bins").alias("bin"),
        F.round("z.bi", 3).alias("bi"), F.col("z.ibg").alias("ibg"),
    )


@query(
    "ping_burst_chunks",
    f"""WITH {PING_BINS},
    a AS (SELECT label, bin, m, coalesce(bin - lag(bin) OVER w, 0) AS ibg, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY label) AS n
          FROM pb WHERE m >= 20 WINDOW w AS (PARTITION BY label ORDER BY bin))
    SELECT label || '_' || (p // 10) AS example_id, label, CAST(p // 10 AS INTEGER) AS chunk_idx, p % 10 AS pos,
           round(m, 6) AS bi, CASE WHEN p % 10 = 0 THEN 0 ELSE ibg END AS ibg,
           first_value(bin) OVER (PARTITION BY label, p // 10 ORDER BY bin) AS first_bin
    FROM a WHERE p < n // 10 * 10""",
)
def ping_burst_chunks(spark, sf):
    means = D.mean_bins(ping_samples(spark, sf), ["label"], "second", "latency_ms", 10_800)
    rows = B.burst_rows(means, ["label"], "mean_value", threshold=20.0)
    got = B.burst_chunks(rows, ["label"], 10)
    long = B.burst_long(got, ["example_id", "label", "chunk_idx"])
    return long.withColumn("bi", F.round("bi", 6))


# ---- bursts -------------------------------------------------------------------------------

FLAGSHIP = src.EVENTS + """,
h AS (SELECT user_id, second // 3600 AS bin, CAST(sum(cents) AS BIGINT) AS v FROM ev GROUP BY ALL),
a AS (
  SELECT user_id, bin, v AS bi, row_number() OVER w - 1 AS pos, coalesce(bin - lag(bin) OVER w, 0) AS ibg,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM h WHERE v >= 1000 WINDOW w AS (PARTITION BY user_id ORDER BY bin))"""


@query("bursts_by_entity", f"WITH {FLAGSHIP} SELECT user_id, pos, bin, bi, ibg FROM a WHERE n >= 10")
def bursts_by_entity(spark, sf):
    ev = src.events(spark, sf, "user_id", "second", "cents")
    bins = ev.groupBy("user_id", F.floor(F.col("second") / src.HOUR).cast("long").alias("bin")).agg(
        F.sum("cents").alias("v")
    )
    return B.burst_rows(bins, ["user_id"], "v", threshold=src.THRESHOLD, min_bursts=10, chunk_bins=168)


@query("bursts_from_series", f"WITH {src.BURSTS} SELECT user_id, pos, bin, bi, ibg * 3600000 AS ibg FROM bursts")
def bursts_from_series(spark, sf):
    got = B.bursts_from_series(
        src.series(spark, sf), ["user_id"], threshold=src.THRESHOLD, min_len=5,
        unit=3_600_000, keep_bins=True,
    )
    long = B.burst_long(got, ["user_id"], ["bi", "ibg", "active_bins"])
    return long.select("user_id", "pos", F.col("active_bins").alias("bin"), "bi", "ibg")


@query("burst_bins_rebuild", f"WITH {src.BURSTS} SELECT user_id, pos, bin FROM bursts")
def burst_bins_rebuild(spark, sf):
    return B.rebuild_bins(src.bursts(spark, sf), ["user_id"])


@query(
    "burst_expand_roundtrip",
    f"""WITH {src.BURSTS},
    f AS (SELECT user_id, min(bin) AS b0, max(bin) AS b1 FROM bursts GROUP BY ALL)
    SELECT s.user_id, s.i - f.b0 AS t, CASE WHEN s.vin >= 1000 THEN s.vin ELSE 0 END::DOUBLE AS v
    FROM series s JOIN f USING (user_id) WHERE s.i BETWEEN f.b0 AND f.b1""",
)
def burst_expand_roundtrip(spark, sf):
    b = src.bursts(spark, sf).withColumn("t", B.expand_timeline(F.col("ibg"), F.col("bi")))
    long = S.series_long(b, ["user_id"], "t")
    return long.select("user_id", F.col("time_index").cast("long").alias("t"), F.col("value").alias("v"))


@query(
    "bursts_covering_prefix",
    f"""WITH {src.BURSTS},
    c AS (SELECT user_id, pos, sum(greatest(1, ibg)) OVER (PARTITION BY user_id ORDER BY pos) AS reach FROM bursts)
    SELECT user_id, CAST(coalesce(min(pos) FILTER (WHERE reach >= 100) + 1, count(*)) AS INTEGER) AS k FROM c GROUP BY ALL""",
)
def bursts_covering_prefix(spark, sf):
    b = src.bursts(spark, sf)
    return b.select("user_id", B.bursts_covering(F.col("ibg"), F.lit(100)).alias("k"))


# ---- splits -------------------------------------------------------------------------------

META = """example_id, user_id, first_bin, _burst_count, _seq_len, context_len, forecast_len,
context_end_bin, forecast_start_bin, forecast_end_bin, split"""


@query("split_geometry", f"WITH {src.SPLITS} SELECT {META} FROM splits")
def split_geometry(spark, sf):
    return S.splits_meta(src.splits(spark, sf), ["user_id"])


@query(
    "split_rows",
    f"""WITH {src.SPLITS} SELECT s.user_id, s.split, CASE WHEN b.pos < s.context_len THEN 'context' ELSE 'forecast' END AS part,
    CASE WHEN b.pos < s.context_len THEN b.pos ELSE b.pos - s.context_len END AS pos, b.bi, b.ibg
    FROM splits s JOIN bursts b USING (user_id)""",
)
def split_rows(spark, sf):
    sp = src.splits(spark, sf)
    parts = F.array(
        *[
            F.struct(F.lit(p).alias("part"), F.arrays_zip(F.col(f"{p}_bi").alias("bi"), F.col(f"{p}_ibg").alias("ibg")).alias("z"))
            for p in ("context", "forecast")
        ]
    )
    each = sp.select("user_id", "split", F.explode(parts).alias("p"))
    rows = item_rows(each.select("user_id", "split", "p.part", "p.z"), ["user_id", "split", "part"], "z", item="z")
    return rows.select("user_id", "split", "part", F.col("pos").cast("long").alias("pos"), "z.bi", "z.ibg")


@query(
    "split_hash",
    """SELECT CASE WHEN ('0x' || substr(md5('7_' || l_orderkey || '_' || l_linenumber), 1, 8))::BIGINT / 4294967296.0 < 0.8
       THEN 'train' ELSE 'test' END AS split, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def split_hash(spark, sf):
    li = src.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return S.assign_split(li, ["l_orderkey", "l_linenumber"], 0.8, seed=7).groupBy("split", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "train_val_cut",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('42_' || event_id), event_id) AS rn, count(*) OVER () AS n FROM events)
    SELECT event_id, CASE WHEN rn <= trunc(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r""",
)
def train_val_cut(spark, sf):
    return S.shuffle_cut(src.table(spark, sf, "events", "event_id"), ["event_id"], 0.9)


MIRROR = src.SPLITS + """,
slen AS (SELECT user_id, count(*) AS n FROM series GROUP BY ALL),
cut AS (
  SELECT s.user_id, s.split, s.context_len, s.forecast_len, l.n,
         least(l.n, s.forecast_start_bin) AS t_ctx, s.forecast_start_bin AS t_from,
         greatest(0, least(l.n - s.forecast_start_bin, s.forecast_end_bin - s.forecast_start_bin + 1)) AS t_len
  FROM splits s JOIN slen l USING (user_id))"""


def _mirror(spark, sf, mode):
    return S.mirror_series(
        src.series(spark, sf), S.splits_meta(src.splits(spark, sf), ["user_id"]), ["user_id"],
        mode=mode, threshold=src.THRESHOLD,
    )


def _mirror_sums(df):
    def figures(c):
        a = F.col(c)
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        place = F.aggregate(F.transform(a, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
        return [F.size(a).alias(f"{c}_n"), total.alias(f"{c}_sum"), place.alias(f"{c}_place")]

    cols = [f"{p}_{d}" for d in ("inbound", "outbound") for p in ("context", "forecast")]
    return df.select("user_id", "split", *[x for c in cols for x in figures(c)])


def _mirror_sql(ctx_len, start, length):
    parts = []
    for d, v in (("inbound", "vin"), ("outbound", "vout")):
        for p, cond, off in (
            ("context", f"s.i < {ctx_len}", "0"),
            ("forecast", f"s.i >= {start} AND s.i < {start} + {length}", start),
        ):
            parts.append(f"CAST(count(*) FILTER (WHERE {cond}) AS INTEGER) AS {p}_{d}_n")
            parts.append(f"coalesce(sum(s.{v}) FILTER (WHERE {cond}), 0)::DOUBLE AS {p}_{d}_sum")
            parts.append(f"coalesce(sum(s.{v} * (s.i - {off})) FILTER (WHERE {cond}), 0)::DOUBLE AS {p}_{d}_place")
    return f"WITH {MIRROR} SELECT s.user_id, c.split, {', '.join(parts)} FROM series s JOIN cut c USING (user_id) GROUP BY s.user_id, c.split"


@query("mirror_by_time", _mirror_sql("c.t_ctx", "c.t_from", "c.t_len"))
def mirror_by_time(spark, sf):
    return _mirror_sums(_mirror(spark, sf, "burst_timestamp"))


@query("mirror_by_index", _mirror_sql("c.context_len", "c.context_len", "c.forecast_len"))
def mirror_by_index(spark, sf):
    return _mirror_sums(_mirror(spark, sf, "legacy_index"))


@query(
    "burst_parity",
    f"""WITH {MIRROR},
    p AS (SELECT c.user_id, count(*) FILTER (WHERE s.i >= c.t_from AND s.i < c.t_from + c.t_len AND s.vin >= 1000) AS found,
                 any_value(c.forecast_len) AS want FROM series s JOIN cut c USING (user_id) WHERE c.split = 'test' GROUP BY c.user_id)
    SELECT CAST(coalesce(sum((found <> want)::INT), 0) AS BIGINT) AS mismatches, count(*) AS total FROM p""",
)
def burst_parity(spark, sf):
    return S.burst_parity(_mirror(spark, sf, "burst_timestamp"))


@query(
    "training_windows",
    f"""WITH {src.BURSTS}, l AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM bursts)
    SELECT user_id, CAST(pos // 16 * 16 AS INTEGER) AS window_start, CAST(count(*) AS INTEGER) AS n,
           CAST(sum(bi) AS DOUBLE) AS bi_sum, CAST(sum(ibg) AS DOUBLE) AS ibg_sum
    FROM l GROUP BY user_id, pos // 16 HAVING count(*) >= 10 OR any_value(n) <= 16""",
)
def training_windows(spark, sf):
    got = S.training_windows(src.bursts(spark, sf), ["bi", "ibg"], 16, 10)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return got.select(
        "user_id", "window_start", F.size("bi").alias("n"), total("bi").alias("bi_sum"), total("ibg").alias("ibg_sum")
    )


@query(
    "horizon_splits",
    f"""WITH {FLAGSHIP},
    t AS (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM a GROUP BY ALL),
    p AS (SELECT *, greatest(20, CAST(ceil(0.7::DOUBLE * n) AS INTEGER)) AS c0 FROM t),
    q AS (SELECT *, CASE WHEN n - c0 < 12 THEN greatest(20, c0 - least(20, 12 - (n - c0))) ELSE c0 END AS c1 FROM p),
    r AS (SELECT *, CASE WHEN n - c1 <= 0 AND n > 20 THEN n - 1 ELSE c1 END AS c2, greatest(20, n - 12) AS lc FROM q)
    SELECT user_id, n, CASE WHEN n >= 32 AND n - c2 > 0 THEN c2 END AS context, CASE WHEN n >= 32 AND n - c2 > 0 THEN n - c2 END AS horizon,
           CASE WHEN n >= 32 AND n - lc > 0 THEN lc END AS longest_context, CASE WHEN n >= 32 AND n - lc > 0 THEN n - lc END AS longest_horizon
    FROM r""",
)
def horizon_splits(spark, sf):
    counts = bursts_by_entity_all(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    c, h = S.horizon_split(F.col("n"), min_ctx=20, min_h=12)
    lc, lh = S.horizon_split(F.col("n"), min_ctx=20, min_h=12, longest=True)
    return counts.select(
        "user_id", "n", c.alias("context"), h.alias("horizon"), lc.alias("longest_context"), lh.alias("longest_horizon")
    )


def bursts_by_entity_all(spark, sf):
    ev = src.events(spark, sf, "user_id", "second", "cents")
    bins = ev.groupBy("user_id", F.floor(F.col("second") / src.HOUR).cast("long").alias("bin")).agg(
        F.sum("cents").alias("v")
    )
    return B.burst_rows(bins, ["user_id"], "v", threshold=src.THRESHOLD)


@query(
    "positive_clean",
    f"""WITH {src.SERIES}, p AS (SELECT user_id, vin, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM series WHERE vin > 0)
    SELECT user_id, CAST(least(count(*), 30) AS INTEGER) AS n, CAST(sum(vin) FILTER (WHERE k <= 30) AS DOUBLE) AS total,
           CAST(sum(vin * k) FILTER (WHERE k <= 30) AS DOUBLE) AS place
    FROM p GROUP BY user_id HAVING count(*) >= 10""",
)
def positive_clean(spark, sf):
    got = S.positive_only(src.series(spark, sf).select("user_id", "inbound"), ["inbound"], 10, 30)
    place = F.aggregate(F.transform("inbound", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return got.select(
        "user_id", F.size("inbound").alias("n"),
        F.aggregate("inbound", F.lit(0.0), lambda a, x: a + x).alias("total"), place.alias("place"),
    )


LOADER = f"""WITH {src.BURSTS},
    b AS (SELECT user_id, count(*) AS nb, CASE WHEN max(bi) > 16000 THEN count(*) - 1 ELSE count(*) END AS ng FROM bursts GROUP BY ALL)"""


def _uneven(spark, sf):
    """Bursts where series with a large value lack their last gap and those without any have no gaps."""
    b = src.bursts(spark, sf)
    big = F.array_max("bi") > 16_000
    return b.withColumn("ibg", F.when(big, F.slice("ibg", 1, F.size("ibg") - 1)).otherwise(F.col("ibg")))


@query("burst_loader", LOADER + " SELECT user_id, CAST(least(nb, 30) AS INTEGER) AS n FROM b WHERE nb = ng AND nb >= 8")
def burst_loader(spark, sf):
    return S.burst_loader(_uneven(spark, sf), 8, 30).select("user_id", F.size("bi").alias("n"))


@query(
    "split_loader",
    f"""WITH {src.SPLITS} SELECT user_id, context_len, forecast_len FROM splits
    WHERE context_len >= 1 AND forecast_len >= 1 AND _seq_len >= 38""",
)
def split_loader(spark, sf):
    return S.split_loader(src.splits(spark, sf), 38).select("user_id", "context_len", "forecast_len")


@query(
    "nested_loader",
    f"""WITH {src.SERIES}, x AS (SELECT user_id, i, vin, vout FROM series)
    SELECT user_id, CAST(0 AS INTEGER) AS part, CAST(count(*) FILTER (WHERE vin <> 0) AS INTEGER) AS n,
           CAST(sum(vin) AS DOUBLE) AS total FROM x GROUP BY user_id HAVING count(*) FILTER (WHERE vin <> 0) >= 3""",
)
def nested_loader(spark, sf):
    s = src.series(spark, sf)
    lead = F.array(F.lit(0.0))
    nested = s.select(
        "user_id",
        F.array(F.concat(lead, F.col("inbound")), F.concat(F.array(F.lit(1.0)), F.col("outbound"))).alias("parts"),
    )
    got = S.nested_loader(nested, ["user_id"], "parts", 3)
    return got.select(
        "user_id", "part", F.size("series").alias("n"),
        F.aggregate("series", F.lit(0.0), lambda a, x: a + x).alias("total"),
    )


@query(
    "aligned_pairs",
    f"""WITH {src.BURSTS},
    c AS (SELECT user_id, pos AS p, bi::DOUBLE AS v, ibg::DOUBLE AS g FROM bursts)
    SELECT user_id, CAST(p AS INTEGER) AS time_index, v AS left_value,
    lead(g) OVER (PARTITION BY user_id ORDER BY p) AS right_value FROM c""",
)
def aligned_pairs(spark, sf):
    b = src.bursts(spark, sf).select(
        "user_id", F.col("bi").cast("array<double>").alias("bi"),
        # the gaps between bursts: one less than bursts
        F.slice("ibg", 2, F.size("ibg")).cast("array<double>").alias("ibg"),
    )
    return S.aligned_long(b, ["user_id"], "bi", "ibg")


# ---- quantiles ----------------------------------------------------------------------------

ITEMS = src.SERIES + """,
items AS (
  SELECT 'inbound' AS entity_type, vin::DOUBLE AS v FROM series
  UNION ALL SELECT 'outbound', vout::DOUBLE FROM series)"""


def _items(spark, sf):
    s = src.series(spark, sf)
    two = F.array(
        F.struct(F.lit("inbound").alias("entity_type"), F.col("inbound").alias("a")),
        F.struct(F.lit("outbound").alias("entity_type"), F.col("outbound").alias("a")),
    )
    return s.select(F.explode(two).alias("e")).select("e.entity_type", "e.a")


@query(
    "quantile_levels",
    f"""WITH {ITEMS}, q AS (SELECT entity_type, unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]::DOUBLE[]) AS level,
      unnest(quantile_cont(v, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS quantile FROM items GROUP BY entity_type)
    SELECT entity_type, level, round(quantile, 6) AS quantile FROM q""",
)
def quantile_levels(spark, sf):
    table = Q.item_quantiles(_items(spark, sf), "a", ["entity_type"], exact=True)
    return Q.quantile_rows(table, ["entity_type"]).withColumn("quantile", F.round("quantile", 6))


@query("quantile_levels_sketch")
def quantile_levels_sketch(spark, sf):
    return Q.quantile_rows(Q.item_quantiles(_items(spark, sf), "a", ["entity_type"]), ["entity_type"])


def _day_sketches(spark, sf):
    """Sketches of the values per kind of event and day, stored."""
    ev = src.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    return ev, cut_lineage(Q.value_sketches(ev, ["event_type", "day"], "value"), "day-sketches")


@query(
    "sketch_rank_check",
    """WITH l AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS level)
    SELECT event_type, level, count(*) AS n, TRUE AS within_one_percent FROM events, l WHERE value IS NOT NULL GROUP BY ALL""",
)
def sketch_rank_check(spark, sf):
    """Quantiles of all days from the days' stored sketches: every rank is within one percent of its level."""
    ev, days = _day_sketches(spark, sf)
    table = Q.sketch_quantiles(Q.merged_sketches(days, ["event_type"]), [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    got = Q.rank_errors(table, ev, ["event_type"], "value")
    return got.select("event_type", "level", "n", (F.col("error") <= 0.01).alias("within_one_percent"))


@query(
    "sketch_days",
    """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(value) AS n, min(value) AS lowest, max(value) AS highest
    FROM events GROUP BY ALL""",
)
def sketch_days(spark, sf):
    """What the stored sketch of each day knows exactly: how many values, the smallest and the largest."""
    _, days = _day_sketches(spark, sf)
    ends = Q.sketch_quantiles(days, [0.0, 1.0])
    return ends.select("event_type", F.col("day").cast("string").alias("day"), "n", F.get("quantiles", F.lit(0)).alias("lowest"), F.get("quantiles", F.lit(1)).alias("highest"))


@query(
    "threshold_interp",
    f"""WITH {ITEMS}, q AS (SELECT entity_type, quantile_cont(v, [0.9, 0.95, 0.99, 1.0]) AS q FROM items GROUP BY entity_type)
    SELECT entity_type, round(q[1], 4) AS at_low, round(q[2] + (q[3] - q[2]) * (0.97::DOUBLE - 0.95) / (0.99::DOUBLE - 0.95), 4) AS at_97,
           round(q[4], 4) AS at_top FROM q""",
)
def threshold_interp(spark, sf):
    table = Q.item_quantiles(_items(spark, sf), "a", ["entity_type"], levels=[0.9, 0.95, 0.99, 1.0], exact=True)
    lv, qs = F.col("levels"), F.col("quantiles")
    return table.select(
        "entity_type",
        F.round(Q.interpolate(lv, qs, 0.05), 4).alias("at_low"),
        F.round(Q.interpolate(lv, qs, 0.97), 4).alias("at_97"),
        F.round(Q.interpolate(lv, qs, 1.0), 4).alias("at_top"),
    )


@query(
    "running_value_counts",
    """WITH c AS (SELECT l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT value, n, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS upto FROM c""",
)
def running_value_counts(spark, sf):
    return Q.cumulative_counts(src.table(spark, sf, "lineitem", "l_extendedprice"), "l_extendedprice")


def _gap_values(spark, sf):
    return B.burst_long(src.bursts(spark, sf), ["user_id"]).select(F.col("bi").cast("double").alias("bi"), "ibg")


@query("quantile_edges")
def quantile_edges(spark, sf):
    """Token edges of both streams; the gap stream has many repeated cuts."""
    rows = []
    values = _gap_values(spark, sf)
    for stream in ("bi", "ibg"):
        for i, e in enumerate(Q.quantile_edges(values.filter(F.col(stream) > 0), stream, 16)):
            rows.append((stream, i, float(e)))
    return spark.createDataFrame(rows, "stream string, i int, edge double")


@query(
    "quantile_edges_prices",
    """WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem),
    c AS (SELECT o.v FROM o JOIN (SELECT unnest(range(1, 16)) AS i) r ON o.k = floor(r.i * 6.25::DOUBLE / 100 * (o.n - 1)) UNION ALL SELECT max(v) FROM o),
    f AS (SELECT list(v ORDER BY v) AS e FROM c),
    w AS (SELECT unnest(list_concat(e, [(e[1] + e[2]) / 2])) AS edge FROM f)
    SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS BIGINT) AS i, edge FROM w""",
)
def quantile_edges_prices(spark, sf):
    """Edges of a column with hardly any repeats: fifteen cuts, the maximum and one midpoint."""
    edges = Q.quantile_edges(src.table(spark, sf, "lineitem", "l_extendedprice"), "l_extendedprice", 16)
    return spark.createDataFrame(list(enumerate(float(e) for e in edges)), "i long, edge double")


@query(
    "token_boundary_frame",
    f"""WITH {src.BURSTS} SELECT 'first' AS edge, round(min(bi) * 0.8::DOUBLE, 6) AS value FROM bursts
    UNION ALL SELECT 'last', round(max(bi) * 1.2::DOUBLE, 6) FROM bursts""",
)
def token_boundary_frame(spark, sf):
    edges = Q.token_boundaries(_gap_values(spark, sf), "bi", 16)
    return spark.createDataFrame(
        [("first", round(edges[0], 6)), ("last", round(edges[-1], 6))], "edge string, value double"
    )


# ---- tokens -------------------------------------------------------------------------------

EDGES = [1000.0, 2000.0, 3000.0, 4500.0, 6000.0, 8000.0, 12000.0]
EDGE_SQL = "[1000.0, 2000.0, 3000.0, 4500.0, 6000.0, 8000.0, 12000.0]::DOUBLE[]"
SPECIAL, TOKENS = 3, 64


def _long(df, *names):
    zipped = F.arrays_zip(*names)
    return item_rows(df, ["user_id"], zipped, item="z").select(
        "user_id", F.col("pos").cast("long").alias("pos"), *[F.col(f"z.{n}").alias(n) for n in names]
    )


@query(
    "tokens_global",
    f"""WITH {src.BURSTS},
    t AS (SELECT user_id, pos, CAST(least(len(list_filter({EDGE_SQL}, lambda e: e < bi)) + 3, 63) AS INTEGER) AS token FROM bursts),
    c AS (SELECT list_transform(range(1, 7), lambda k: (({EDGE_SQL})[k] + ({EDGE_SQL})[k + 1]) / 2) AS m)
    SELECT user_id, pos, token, m[greatest(0, least(token - 4, 5)) + 1] AS own_value, m[greatest(0, least(token - 3, 5)) + 1] AS above_value
    FROM t, c""",
)
def tokens_global(spark, sf):
    b = src.bursts(spark, sf).withColumn("token", T.encode_global(F.col("bi"), EDGES, n_special=SPECIAL, n_tokens=TOKENS))
    b = b.withColumns(
        {
            "own_value": T.decode_global(F.col("token"), EDGES, n_special=SPECIAL),
            "above_value": T.decode_global(F.col("token"), EDGES, n_special=SPECIAL, decode="reference"),
        }
    )
    return _long(b, "token", "own_value", "above_value")


@query(
    "tokens_global_many",
    f"""WITH {src.BURSTS}
    SELECT user_id, pos, CAST(least(len(list_filter(range(0, 500), lambda k: k * 50 + 17 < bi)) + 3, 4095) AS INTEGER) AS token FROM bursts""",
)
def tokens_global_many(spark, sf):
    """Five hundred edges: the search halves them instead of comparing each."""
    edges = [k * 50 + 17.0 for k in range(500)]
    b = src.bursts(spark, sf).withColumn("token", T.encode_global(F.col("bi"), edges, n_special=SPECIAL, n_tokens=4096))
    return _long(b, "token")


@query(
    "tokens_local",
    f"""WITH {src.BURSTS}, q AS (SELECT user_id, quantile_cont(bi::DOUBLE, [0.125,0.25,0.375,0.5,0.625,0.75,0.875]) AS e FROM bursts GROUP BY ALL)
    SELECT b.user_id, b.pos, CAST(len(list_filter(q.e, lambda x: x < b.bi)) + 3 AS INTEGER) AS token FROM bursts b JOIN q USING (user_id)""",
)
def tokens_local(spark, sf):
    b = src.bursts(spark, sf).withColumn("edges", T.local_edges(F.col("bi"), 8))
    b = b.withColumn("token", T.encode_local(F.col("bi"), F.col("edges"), bins=8, n_special=SPECIAL, n_tokens=TOKENS))
    return _long(b, "token")


@query(
    "tokens_integer",
    f"""WITH {src.BURSTS}
    SELECT user_id, pos, CAST(least(ibg, 9) + 3 AS INTEGER) AS token, least(ibg, 9)::DOUBLE AS value FROM bursts""",
)
def tokens_integer(spark, sf):
    b = src.bursts(spark, sf).withColumn("token", T.encode_integer(F.col("ibg"), bins=10, n_special=SPECIAL, n_tokens=TOKENS))
    b = b.withColumn("value", T.decode_integer(F.col("token"), bins=10, n_special=SPECIAL))
    return _long(b, "token", "value")


@query("auto_bins", f"WITH {src.BURSTS} SELECT CAST(least(greatest(2, max(ibg) + 1), 4096) AS INTEGER) AS bins FROM bursts")
def auto_bins(spark, sf):
    return T.auto_bins(src.bursts(spark, sf), "ibg", 4096)


@query(
    "next_step_pairs",
    f"""WITH {src.BURSTS},
    t AS (SELECT user_id, pos, CAST(least(ibg, 9) + 3 AS INTEGER) AS token FROM bursts),
    l AS (SELECT user_id, pos, token, lead(token) OVER (PARTITION BY user_id ORDER BY pos) AS target FROM t)
    SELECT user_id, CAST(pos AS INTEGER) AS pos, token, target, pos >= 5 AS valid FROM l WHERE target IS NOT NULL""",
)
def next_step_pairs(spark, sf):
    ids = T.encode_integer(F.col("ibg"), bins=10, n_special=SPECIAL, n_tokens=TOKENS)
    b = src.bursts(spark, sf).withColumn("ids", ids)
    return b.select("user_id", F.inline(T.next_step_pairs(F.col("ids"), skip=5)))
