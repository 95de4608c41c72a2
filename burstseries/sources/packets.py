"""Capture files to packet rows: one task per file, records read from the stream one by one."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PACKET_SCHEMA = (
    "source_file string, src_ip string, dst_ip string, src_port int, dst_port int, timestamp double, size int"
)

# Fixed values of the public capture and internet header formats.
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 1e-6),
    b"\xd4\xc3\xb2\xa1": ("<", 1e-6),
    b"\xa1\xb2\x3c\x4d": (">", 1e-9),
    b"\x4d\x3c\xb2\xa1": ("<", 1e-9),
}
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_VLAN = 0x8100
TCP, UDP = 6, 17


def parse_frame(frame: bytes) -> tuple[str, str, int | None, int | None] | None:
    """Addresses and ports of an Ethernet frame with IPv4 inside, else nothing."""
    at = 12
    if len(frame) < 34:
        return None
    kind = int.from_bytes(frame[at : at + 2], "big")
    while kind == ETHERTYPE_VLAN and len(frame) >= at + 6:
        at += 4
        kind = int.from_bytes(frame[at : at + 2], "big")
    ip = at + 2
    if kind != ETHERTYPE_IPV4 or len(frame) < ip + 20 or frame[ip] >> 4 != 4:
        return None
    src = ".".join(map(str, frame[ip + 12 : ip + 16]))
    dst = ".".join(map(str, frame[ip + 16 : ip + 20]))
    first_part = int.from_bytes(frame[ip + 6 : ip + 8], "big") & 0x1FFF == 0
    data = ip + (frame[ip] & 0x0F) * 4
    if frame[ip + 9] in (TCP, UDP) and first_part and len(frame) >= data + 4:
        sport, dport = struct.unpack(">HH", frame[data : data + 4])
        return src, dst, sport, dport
    return src, dst, None, None


def read_capture(name: str, content: bytes, batch: int = 50_000) -> Iterator[pd.DataFrame]:
    """Packet rows of one classic capture file, in batches; a cut-off last record is left out."""
    columns = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
    form = MAGIC.get(bytes(content[:4]))
    if form is None:
        return
    order, unit = form
    header = struct.Struct(order + "IIII")
    view, at, rows = memoryview(content), 24, []
    while at + 16 <= len(view):
        sec, frac, kept, size = header.unpack_from(view, at)
        at += 16
        if at + kept > len(view):
            break
        found = parse_frame(bytes(view[at : at + kept]))
        at += kept
        if found is None:
            continue
        rows.append((name, *found, sec + frac * unit, size))
        if len(rows) >= batch:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for name, content in zip(files["path"], files["content"], strict=True):
            for out in read_capture(name, content):
                out[["src_port", "dst_port"]] = out[["src_port", "dst_port"]].astype("Int32")
                yield out


def scan_captures(spark: SparkSession, path: str, glob: str = "*.pcap") -> DataFrame:
    """Packet rows of all capture files below ``path``.

    Long captures are split into many files before they are loaded (as capture tools do by
    size or time), so one file is a fair unit of work; addresses keep the folder as lineage.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )
    return files.mapInPandas(_rows, PACKET_SCHEMA)
