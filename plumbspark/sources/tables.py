"""Tables: parquet files by name, and small ones that are part of the plan."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``, stored as ``<name>.parquet``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """``rows`` as a local relation, whose size Catalyst knows without a job."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    table = pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(table, schema=kind)
