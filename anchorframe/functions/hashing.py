"""Hash-keyed randomness: reproducible under any partitioning and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_BITS = 16


def order_key(seed: int | str, op: str, *ids: str | Column) -> Column:
    """md5 of ``seed:op:id...``; sorting by it is a random order that anyone can recompute."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(op), *[c.cast("string") for c in cols]))


def uniform_from_key(key: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an order key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(seed: int | str, op: str, *ids: str | Column) -> Column:
    return uniform_from_key(order_key(seed, op, *ids))


def key_bucket(key: Column) -> Column:
    """First 16 bits of an order key: an order-preserving split into 65 536 even parts."""
    return F.conv(F.substring(key, 1, BUCKET_BITS // 4), 16, 10).cast("int")
