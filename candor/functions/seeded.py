"""Seeded pseudo-random numbers as plain column expressions.

A number depends on the seed and the row key only, so it is the same for any
partitioning, after a task retry, and in any SQL engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hexadecimal digits: as many as a bigint holds without a sign.
HASH_BITS = 60


def hash60(seed: int | str, *parts: Column | str) -> Column:
    """First 60 bits of md5('seed:part:...') as a non-negative bigint."""
    pieces = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in pieces])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
