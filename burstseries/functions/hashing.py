"""Placement-independent pseudo-random choices derived from md5 of the row's key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(keys, sep: str = "_") -> Column:
    return F.concat_ws(sep, *[F.col(k).cast("string") for k in keys])


def hash32(keys, seed: int | str = "", sep: str = "_") -> Column:
    """The first 32 bits of md5(seed, keys) as a long in [0, 2^32)."""
    return F.conv(F.substring(hash_hex(keys, seed, sep), 1, 8), 16, 10).cast("long")


def hash_hex(keys, seed: int | str = "", sep: str = "_") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}{sep}"), key_text(keys, sep)))


def unit_hash(keys, seed: int | str = "", sep: str = "_") -> Column:
    """A stable uniform number in [0, 1)."""
    return hash32(keys, seed, sep) / F.lit(4294967296.0)
