"""Session helpers: lineage cuts and size-checked decisions."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder stands in for it in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="anchorframe-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, every later reader
    sees the same rows, and the planner knows the size (small tables are broadcast on it).
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_ROWS = 100_000


def try_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame | None:
    """The table as a local relation marked for broadcast, or None when it has more than ``limit`` rows."""
    rows = df.limit(limit + 1).toArrow()
    return None if rows.num_rows > limit else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Evaluate a table expected to be small, once.

    Up to ``limit`` rows it comes back as a local relation marked for broadcast, so the large side of
    a join is never shuffled for it. Beyond the limit it is written out and joined like any table.
    """
    small = try_small(df, limit)
    return materialize(df) if small is None else small


def local_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Driver-held rows (a bounded result table) as a local relation."""
    columns = [pa.array([r.get(f.name) for r in rows], type=to_arrow_type(f.dataType)) for f in schema]
    table = pa.Table.from_arrays(columns, names=schema.names)
    return spark.createDataFrame(table, schema)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must stay small; one row over the limit is an error, never a truncation."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows would reach the driver")
    return rows
