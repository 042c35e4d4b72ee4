"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def _micros_of_day(c: Column) -> Column:
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return seconds.cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def day_offset(obs: str | Column, anchor: str | Column, mode: str = "date") -> Column:
    """Signed days from anchor to observation (negative = before the event).

    ``date`` compares calendar days; ``raw`` is fractional days; ``floor`` rounds raw down;
    ``trunc`` rounds raw towards zero, so day 0 spans 48 hours; ``abs`` is the magnitude of raw.
    """
    o = F.col(obs) if isinstance(obs, str) else obs
    a = F.col(anchor) if isinstance(anchor, str) else anchor
    if mode == "date":
        return F.datediff(o.cast("date"), a.cast("date"))
    # wall-clock difference, so a session time zone with daylight saving cannot shift it
    raw = F.datediff(o.cast("date"), a.cast("date")) + (_micros_of_day(o) - _micros_of_day(a)) / F.lit(MICROS_PER_DAY)
    if mode == "raw":
        return raw
    if mode == "floor":
        return F.floor(raw).cast("int")
    if mode == "trunc":
        return raw.cast("int")
    if mode == "abs":
        return F.abs(raw)
    raise ValueError(f"unknown day offset mode {mode!r}")


def trailing_date(c: str | Column) -> Column:
    """Date held in the last eight digits of an identifier; NULL when there is none."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_date(F.nullif(F.regexp_extract(col, r"(\d{8})$", 1), F.lit("")), "yyyyMMdd")


def calendar_parts(c: str | Column, prefix: str = "") -> list[Column]:
    col = F.col(c) if isinstance(c, str) else c
    return [
        F.year(col).alias(f"{prefix}year"),
        F.dayofyear(col).alias(f"{prefix}day_of_year"),
        F.month(col).alias(f"{prefix}month"),
        F.date_format(col, "MMM").alias(f"{prefix}month_abbr"),
    ]


def year_index(c: str | Column, origin: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.year(col) - F.lit(origin)


def decade_bucket(index: Column) -> Column:
    """1, 2, 3 for a year index up to 10, between 10 and 20, and from 20 on."""
    return F.when(index <= 10, 1).when(index < 20, 2).when(index >= 20, 3)
