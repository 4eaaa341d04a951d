"""Seeded, partition-independent randomness.

Random draws are functions of a seed and a row's own key, so a lost task redraws the same
values. MD5 is used because its digest is the same in every SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: Column | int, *keys: Column) -> Column:
    """Hex digest of ``seed|key|key..``; ordering by it is a seeded shuffle."""
    first = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", first.cast("string"), *[k.cast("string") for k in keys]))


def uniform(seed: Column | int, *keys: Column) -> Column:
    """Uniform double strictly between 0 and 1."""
    return to_uniform(digest(seed, *keys))


def to_uniform(hex_digest: Column) -> Column:
    """First 32 bits of a digest as a double strictly between 0 and 1."""
    number = F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(4294967296.0)


def integer_below(seed: Column | int, bound: int, *keys: Column) -> Column:
    """Uniform integer in ``[0, bound)``."""
    number = F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(bound).cast("bigint"))
