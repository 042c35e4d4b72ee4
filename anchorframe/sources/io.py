"""Scans, sinks and spines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from anchorframe.operators.ranking import value_rank
from anchorframe.operators.tables import append

# Geometry travels as an array of rings, each an array of points, with the reference system beside it.
GEOMETRY = "geometry array<array<struct<x:double,y:double>>>, srid int"


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """Delimited text with a header and a declared schema; the text ``NA`` is missing."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, nullValue="NA", nanValue="NaN")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_polygons(spark: SparkSession, path: str, attributes: str) -> DataFrame:
    return spark.read.schema(f"{attributes}, {GEOMETRY}").parquet(path)


def read_many(frames: Sequence[DataFrame]) -> DataFrame:
    """Several files as one table, absent columns filled with NULL."""
    return append(*frames)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)


def with_chunks(df: DataFrame, order: str, rows_per_chunk: int) -> DataFrame:
    """Number consecutive fixed-size chunks in the order of a unique numeric column."""
    ranked = value_rank(df, [], order, [order], "__row")
    return ranked.withColumn("chunk", F.floor((F.col("__row") - 1) / F.lit(rows_per_chunk)).cast("int")).drop("__row")


def write_chunks(df: DataFrame, path: str, order: str, rows_per_chunk: int, fmt: str = "parquet") -> None:
    write_table(with_chunks(df, order, rows_per_chunk), path, fmt, ["chunk"])


def date_spine(bounds: DataFrame, start: str, end: str, out: str = "date") -> DataFrame:
    """Every day between two date columns, inclusive; other columns are kept."""
    days = F.sequence(F.col(start).cast("date"), F.col(end).cast("date"), F.expr("interval 1 day"))
    return bounds.withColumn(out, F.explode(days))


def numeric_spine(spark: SparkSession, start: float, stop: float, step: float, out: str = "x") -> DataFrame:
    n = int(round((stop - start) / step)) + 1
    return spark.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(out))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def literal_lookup(c: str | Column, table: Mapping) -> Column:
    """Value of a small literal key table; a key without an entry gives NULL."""
    key = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)
