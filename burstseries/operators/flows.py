"""Packets and flows to per-entity byte counts in time bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstseries.functions.ordered import join_on
from burstseries.functions.ranges import WIDTH, dense_ranks
from burstseries.session import cut_lineage

TICK_MS = 100


def not_localhost(*columns: str) -> Column:
    """No address is a loopback one; a null address fails the test, as a comparison with null does."""
    test = F.lit(True)
    for c in columns:
        test = test & ~F.col(c).startswith("127.")
    return test


def subnet24(ip: Column) -> Column:
    return F.substring_index(ip, ".", 3)


def service_port_filled(src: Column, dst: Column) -> Column:
    """Packet rule: the smaller port, a missing one counting as 0."""
    return F.least(F.coalesce(src, F.lit(0)), F.coalesce(dst, F.lit(0)))


def service_port_flow(src: Column, dst: Column) -> Column:
    """Flow rule: the source port where it is smaller, else (also when one is missing) the destination port."""
    return F.when(src < dst, src).otherwise(dst)


def service_port_known(src: Column, dst: Column) -> Column:
    """Session rule: the smaller known port, null only when both are missing."""
    return F.least(src.cast("long"), dst.cast("long"))


def tick(timestamp: Column) -> Column:
    """Index of the 100 ms tick of an epoch-second timestamp."""
    return (timestamp * 10).cast("long")


def window_index(timestamp: Column, window_ms: int) -> Column:
    ms = (timestamp.cast("double") * 1000.0).cast("long")
    return F.floor(ms / F.lit(float(window_ms))).cast("long")


def bin_factor(bin_ms: int) -> int:
    if bin_ms < TICK_MS or bin_ms % TICK_MS:
        raise ValueError(f"bin_ms must be a multiple of {TICK_MS} and at least {TICK_MS}, not {bin_ms}")
    return bin_ms // TICK_MS


def rebin(tick_column: Column, bin_ms: int) -> Column:
    return F.floor(tick_column / F.lit(bin_factor(bin_ms))).cast("long")


def direction_bytes(outbound: Column, size: Column) -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    size = size.cast("long")
    return {
        "inbound_bytes": F.when(~outbound, size).otherwise(zero),
        "outbound_bytes": F.when(outbound, size).otherwise(zero),
    }


def packet_bytes(packets: DataFrame) -> DataFrame:
    """Packets without loopback, with tick, service port and bytes per direction."""
    kept = packets.filter(not_localhost("src_ip", "dst_ip"))
    port = service_port_filled(F.col("src_port"), F.col("dst_port")).cast("long")
    kept = kept.withColumns({"window_start": tick(F.col("timestamp")), "service_port": port})
    outbound = F.coalesce(F.col("dst_port"), F.lit(-1)) == F.col("service_port")
    return kept.withColumns(direction_bytes(outbound, F.col("size")))


def flow_bytes(flows: DataFrame, window_ms: int) -> DataFrame:
    """Flows with window index, service port and bytes per direction (both 0 when the port is unknown)."""
    port = service_port_flow(F.col("src_port"), F.col("dst_port")).cast("long")
    out = flows.withColumns({"window_start": window_index(F.col("timestamp"), window_ms), "service_port": port})
    return out.withColumns(direction_bytes(F.col("service_port") == F.col("dst_port"), F.col("size")))


def both_ends(traffic: DataFrame) -> DataFrame:
    """Each row once for its source and once, directions swapped, for its destination: one scan."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("inbound_bytes").alias("i"), F.col("outbound_bytes").alias("o"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("outbound_bytes").alias("i"), F.col("inbound_bytes").alias("o"))
    sides = traffic.select("window_start", "service_port", "source_file", F.explode(F.array(src, dst)).alias("e"))
    return sides.select(
        "window_start",
        F.col("e.ip").alias("ip"),
        "service_port",
        "source_file",
        F.col("e.i").alias("inbound_bytes"),
        F.col("e.o").alias("outbound_bytes"),
    )


def entity_ticks(sides: DataFrame, keys: Sequence[str] = ("window_start", "ip", "service_port", "source_file")):
    """Bytes per direction by tick, address and port; partial sums are made before the shuffle."""
    return sides.groupBy(*keys).agg(
        F.sum("inbound_bytes").alias("total_inbound_bytes"),
        F.sum("outbound_bytes").alias("total_outbound_bytes"),
    )


def pair_ticks(traffic: DataFrame) -> DataFrame:
    """Bytes by tick and directed address pair; nothing is counted as outbound."""
    return traffic.groupBy("window_start", "src_ip", "dst_ip", "source_file").agg(
        F.sum(F.col("size").cast("long")).alias("total_inbound_bytes"),
        F.lit(0).cast("long").alias("total_outbound_bytes"),
    )


def unified_ticks(ticks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Address rows and pair rows in one table, absent columns null."""
    return ticks.withColumn("subnet", subnet24(F.col("ip"))).unionByName(pairs, allowMissingColumns=True)


def level_bins(ticks: DataFrame, bin_ms: int) -> DataFrame:
    """Bytes per bin at address, address+port and subnet level.

    An address lies in one subnet, so the rows are shuffled once, by (subnet, source file, bin), and each level is
    summed where they then are: address+port first, the address level from it, the subnet level from that.
    """
    keyed = ticks.withColumns({"bin": rebin(F.col("window_start"), bin_ms), "subnet": subnet24(F.col("ip"))})
    keyed = keyed.select("subnet", "ip", "service_port", "source_file", "bin", "total_inbound_bytes", "total_outbound_bytes")
    totals = ["total_inbound_bytes", "total_outbound_bytes"]
    sums = [F.sum(c).alias(c) for c in totals]
    ports = keyed.repartition("subnet", "source_file", "bin").groupBy("subnet", "ip", "service_port", "source_file", "bin").agg(*sums)
    addresses = ports.groupBy("subnet", "ip", "source_file", "bin").agg(*sums)
    subnets = addresses.groupBy("subnet", "source_file", "bin").agg(*sums)

    def level(df: DataFrame, name: str, *absent: str) -> DataFrame:
        dims = ["subnet", "ip", "service_port", "source_file", "bin"]
        cols = [F.lit(None).cast(ports.schema[d].dataType).alias(d) if d in absent else F.col(d) for d in dims]
        return df.select(*cols, *totals, F.lit(name).alias("level"))

    return (
        level(ports, "ip_service", "subnet")
        .unionByName(level(addresses, "ip", "subnet", "service_port"))
        .unionByName(level(subnets, "subnet", "ip", "service_port"))
    )


def pair_bins(pairs: DataFrame, bin_ms: int) -> DataFrame:
    return (
        pairs.withColumn("bin", rebin(F.col("window_start"), bin_ms))
        .groupBy("src_ip", "dst_ip", "source_file", "bin")
        .agg(
            F.sum("total_inbound_bytes").alias("total_inbound_bytes"),
            F.sum("total_outbound_bytes").alias("total_outbound_bytes"),
        )
    )


def rank_ports(ticks: DataFrame, rank_by: str = "row", width: int = WIDTH) -> DataFrame:
    """Replace the port by its dense rank inside the address, largest bytes first.

    ``row`` ranks single aggregate rows, ``port_total`` the port's bytes over all windows. The rows are stored and
    shuffled once by address. Of addresses with over ``width`` rows only distinct (address, bytes) rows are ranked, in
    value ranges of an address, then the rank is joined back.
    """
    if rank_by not in ("row", "port_total"):
        raise ValueError("rank_by is 'row' or 'port_total'")
    total = F.col("total_inbound_bytes") + F.col("total_outbound_bytes")
    columns = ticks.columns
    ticks = cut_lineage(ticks, "ticks")
    hot = ticks.groupBy("ip").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > width).select("ip")
    hot = cut_lineage(hot, "hot-addresses")  # at most rows / width
    some = not hot.isEmpty()
    named = join_on(ticks, F.broadcast(hot), ["ip"], "left_anti") if some else ticks
    named = named.repartition("ip")
    named = named.withColumn("__b", total if rank_by == "row" else F.sum(total).over(Window.partitionBy("ip", "service_port")))
    rank = F.dense_rank().over(Window.partitionBy("ip").orderBy(F.col("__b").desc_nulls_last())).cast("long")
    out = named.withColumn("service_port", rank).select(*columns)
    if not some:
        return out
    named = join_on(ticks, F.broadcast(hot), ["ip"], "left_semi")
    if rank_by == "row":
        named = named.withColumn("__b", total)
    else:
        sums = named.groupBy("ip", "service_port").agg(F.sum(total).alias("__b"))
        named = join_on(named, sums, ["ip", "service_port"])
    ranked = dense_ranks(named.select("ip", "__b").distinct(), ["ip"], "__b", out="__rank", descending=True, width=width)
    return out.unionByName(join_on(named, ranked, ["ip", "__b"]).withColumn("service_port", F.col("__rank")).select(*columns))
