"""Seeded row order: the same in every engine and on every partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading hex digits that buckets are made of, at most.
MAX_DIGITS = 6


def seeded_key(seed: int | str, *ids: Column | str) -> Column:
    """`md5(seed ':' id ':' ...)` as 32 hex digits; sort by it for a seeded shuffle."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def unit_interval(key: Column) -> Column:
    """The first 13 hex digits of a seeded key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def key_bucket(key: Column, digits: int) -> Column:
    """Leading hex digits of a seeded key: equal-sized buckets in key order."""
    return F.substring(key, 1, digits)


def key_head(key: Column) -> Column:
    """The leading `MAX_DIGITS` hex digits of a seeded key as a number, in key order."""
    return F.conv(F.substring(key, 1, MAX_DIGITS), 16, 10).cast("int")


def head_bucket(head: Column, digits: int) -> Column:
    """The bucket of `key_bucket` as a number, from a key's head."""
    return F.shiftright(head, 4 * (MAX_DIGITS - digits))


def bucket_digits(rows: int, per_bucket: int = 1_000_000) -> int:
    """How many leading digits keep each bucket at about `per_bucket` rows."""
    digits = 1
    while digits < MAX_DIGITS and rows > per_bucket * 16**digits:
        digits += 1
    return digits


def seeded_normal(key: Column) -> Column:
    """A standard normal number from a seeded key: digits 1-13 and 14-26 are two uniform numbers, turned by cosine."""
    def uniform(start: int) -> Column:
        return (F.conv(F.substring(key, start, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**13))

    return F.sqrt(F.lit(-2.0) * F.log(uniform(1))) * F.cos(F.lit(2.0 * math.pi) * uniform(14))
