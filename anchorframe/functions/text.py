"""String and category expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_id(c: str | Column) -> Column:
    """One canonical text form: ``"005"`` and ``"123.0"`` become whole numbers, the rest is trimmed.

    Only plain decimal numbers count: a cast alone would also take ``"12d"`` or ``"7f"`` for numbers.
    """
    s = F.trim(_c(c).cast("string"))
    num = s.try_cast("double")
    whole = s.rlike(r"^[+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?$") & (F.abs(num) < F.lit(9.0e15))
    return F.when(whole, num.cast("bigint").cast("string")).otherwise(s)


def relabel(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Recode by dictionary; values without an entry stay as they are."""
    x = _c(c)
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), x), x)


def relabel_pattern(c: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = _c(c)
    for pattern, text in rules:
        out = F.regexp_replace(out, pattern, text)
    return out


def snake_case(c: str | Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(_c(c))), r"[^a-z0-9]+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def level_rank(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position in the ordered level list; values outside it give NULL."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _c(c))
    return F.nullif(pos.cast("int"), F.lit(0))


def with_levels(df: DataFrame, col: str, levels: Sequence[str], rank_col: str = "level_rank") -> DataFrame:
    rank = level_rank(col, levels)
    return df.withColumn(rank_col, rank).withColumn(
        col, F.when(F.col(rank_col).isNotNull(), F.col(col))
    )


def sort_by_level(df: DataFrame, col: str, levels: Sequence[str], *then: str) -> DataFrame:
    """Rows in the order of the level list, values outside it last, ties by the columns ``then``."""
    return df.orderBy(level_rank(col, levels).asc_nulls_last(), *then)


def in_list(c: str | Column, values: Sequence) -> Column:
    """Membership that is false, never NULL, for a NULL value."""
    return F.coalesce(_c(c).isin(list(values)), F.lit(False))
