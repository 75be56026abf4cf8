"""Parquet: typed mode is the plain reader; cell mode keeps only what fits a sheet cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELL = (T.BooleanType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType)


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_as_cells(spark: SparkSession, path: str) -> DataFrame:
    """Nested columns are refused; types without a cell form become blanks, and are not even read."""
    df = spark.read.parquet(path)
    if any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in df.schema):
        raise ValueError("nested columns have no place in a sheet")
    return df.select(*(F.col(f"`{f.name}`") if isinstance(f.dataType, _CELL) else F.lit(None).cast("string").alias(f.name) for f in df.schema))


def metadata(path: str) -> list[dict]:
    """Row groups and column chunks of one file."""
    import pyarrow.parquet as pq

    m = pq.ParquetFile(path).metadata
    return [{"row_group": g, "column": m.row_group(g).column(c).path_in_schema, "compression": m.row_group(g).column(c).compression, "values": m.row_group(g).column(c).num_values, "bytes": m.row_group(g).column(c).total_compressed_size} for g in range(m.num_row_groups) for c in range(m.num_columns)]
