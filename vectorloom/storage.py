"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only if its values, summed up, with this much more for each row, stay below the limit.
ROW_BYTES = 32
BROADCAST_LIMIT_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new local one where it is unset and
    the driver does all work itself (tests). On a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vectorloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; null: 8."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column) + 8
    elif isinstance(kind, T.StructType):
        size = sum((value_bytes(column[f.name], f.dataType) for f in kind), F.lit(8))
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            size = F.aggregate(column, F.lit(8).cast("long"), lambda held, x: held + value_bytes(x, kind.elementType).cast("long"))
        else:
            size = F.size(column) * 8 + 8
    elif isinstance(kind, T.MapType):
        size = value_bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(column), T.ArrayType(kind.valueType))
    else:
        size = F.lit(16 if isinstance(kind, T.DecimalType) else 8)
    return F.coalesce(size, F.lit(8)).cast("long")


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take, counted over all of them."""
    rows = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_BYTES).cast("long"))
    return df.agg(F.sum(rows)).first()[0] or 0


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Mark a table for broadcast if its summed bytes are few; otherwise leave the join to the planner."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_LIMIT_BYTES else df
