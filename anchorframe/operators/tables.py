"""Column-wise and row-wise table operators: missing values, reshaping, appending, group filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorframe.functions.numbers import is_missing
from anchorframe.operators.joins import semi_join
from anchorframe.operators.ranking import attach
from anchorframe.session import collect_bounded, materialize, small_table

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if c not in exclude and (t in NUMERIC or t.startswith("decimal"))]


def _missing(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    types = dict(df.dtypes)
    return [is_missing(c, types[c]) for c in cols]


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value (NULL or NaN) in any of the columns."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def rows_with_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, _missing(df, cols or df.columns)))


def fill_missing(df: DataFrame, value: float = 0, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL and NaN in numeric columns."""
    types = dict(df.dtypes)
    names = set(cols or numeric_columns(df))
    return df.select(*[
        F.when(is_missing(c, types[c]), F.lit(value)).otherwise(F.col(c)).cast(types[c]).alias(c)
        if c in names else F.col(c) for c in df.columns])


def drop_columns_with_nulls(df: DataFrame) -> DataFrame:
    """Keep only columns without any missing value; one small job decides the schema."""
    flags = df.agg(*[F.max(m.cast("int")).alias(c) for c, m in zip(df.columns, _missing(df, df.columns))]).first()
    return df.select(*[c for c in df.columns if not flags[c]])


def shared_columns_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append by name on the columns both tables have, in the order of the first."""
    cols = [c for c in first.columns if c in set(second.columns)]
    return first.select(*cols).unionByName(second.select(*cols))


def append(*frames: DataFrame) -> DataFrame:
    """Append by name; a column one table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_strict(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def with_overall_group(df: DataFrame, by: str, label: str, entity: Sequence[str] | None = None) -> DataFrame:
    """Append the whole population as one more group; ``entity`` removes repeats across groups first."""
    whole = df.drop(by)
    if entity:  # of an entity's rows the one with the smallest hash, whatever the partitioning
        every = F.struct(*whole.columns)
        whole = whole.groupBy(*entity).agg(F.min_by(every, F.xxhash64(*whole.columns)).alias("__row")).select("__row.*")
    return df.unionByName(whole.withColumn(by, F.lit(label)))


def pivot_wide(df: DataFrame, ids: Sequence[str], key: str, value: str, keys: Sequence[str],
               fill: float | None = 0.0) -> DataFrame:
    """One column per listed key; absent combinations take ``fill``."""
    aggs = [F.max(F.when(F.col(key) == F.lit(k), F.col(value))).alias(str(k)) for k in keys]
    wide = df.groupBy(*ids).agg(*aggs)
    return wide if fill is None else wide.na.fill(fill, subset=[str(k) for k in keys])


def unpivot_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name",
                 value: str = "value", index: str | None = None, drop_null: bool = True) -> DataFrame:
    """Wide to long; ``index`` adds the 1-based position of the source column."""
    parts = F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).alias("v"), F.lit(i + 1).alias("i"))
                      for i, c in enumerate(cols)])
    out = df.select(*ids, F.explode(parts).alias("__p"))
    picked = [F.col("__p.n").alias(name), F.col("__p.v").alias(value)]
    if index:
        picked.append(F.col("__p.i").alias(index))
    out = out.select(*ids, *picked)
    return out.filter(F.col(value).isNotNull()) if drop_null else out


def complete_scaffold(df: DataFrame, group: str, col: str, levels: Sequence[str] | None = None,
                      max_levels: int = 10_000) -> DataFrame:
    """Every group with every level. Levels are given or read from the data under a size check."""
    if levels is None:
        rows = collect_bounded(df.select(col).distinct().orderBy(col), max_levels, f"levels of {col}")
        levels = [r[0] for r in rows]
    dtype = df.schema[col].dataType
    return df.select(group).distinct().withColumn(col, F.explode(F.array(*[F.lit(v).cast(dtype) for v in levels])))


def keep_groups(df: DataFrame, by: Sequence[str], min_rows: int | None = None, min_distinct: int | None = None,
                distinct_col: str | None = None, where: Column | None = None) -> DataFrame:
    """Rows of groups with at least ``min_rows`` rows (counting only ``where``) or distinct values.

    Group sizes are a partial aggregate and the filter is a semi join, so a hot group is never gathered.
    """
    if min_rows is not None:
        test = F.count(F.when(where, 1) if where is not None else F.lit(1)) >= min_rows
    else:
        col = F.col(distinct_col)
        test = F.count_distinct(F.when(where, col) if where is not None else col) >= min_distinct
    sizes = df.groupBy(*by).agg(test.alias("__keep")).filter("__keep")
    return semi_join(df, materialize(sizes), by)


def with_group_stats(df: DataFrame, by: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add group aggregates as columns by aggregate and join back."""
    return attach(df, materialize(df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])), by)


def duplicate_entities(df: DataFrame, key: str) -> DataFrame:
    """Rows of entities that occur more than once."""
    return keep_groups(df, [key], min_rows=2)


def range_limits(cases: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Largest value of each column by group; NaN (which would sort above all numbers) is left out."""
    return cases.groupBy(*by).agg(*[F.max(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"max_{c}") for c in cols])


def exclude_ids(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Rows but those of the named entities, as for a refit without an influential one; rows without an id stay."""
    return df.filter(F.coalesce(~F.col(key).isin(list(values)), F.lit(True)))


def first_rows(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first k rows in an order that should be total; each task keeps k rows at most."""
    return df.orderBy(*order).limit(k)


def beyond_case_range(rows: DataFrame, limits: DataFrame, by: Sequence[str], all_of: Sequence[str],
                      any_of: Sequence[str] = (), keep_beyond: bool = False) -> DataFrame:
    """Drop rows that exceed the group's case maximum in every ``all_of`` and, if given, some ``any_of`` column.

    A group without cases has no limit: its rows are dropped. A NULL comparison does not exclude.
    """
    over = F.lit(True)
    for c in all_of:
        over = over & (F.col(c) > F.col(f"max_{c}"))
    if any_of:
        over = over & reduce(lambda a, b: a | b, [F.col(c) > F.col(f"max_{c}") for c in any_of])
    flagged = attach(rows, small_table(limits.withColumn("__has", F.lit(True))), by)
    beyond = F.coalesce(over, F.lit(False)) | F.col("__has").isNull()
    return flagged.filter(beyond if keep_beyond else ~beyond).select(*rows.columns)
