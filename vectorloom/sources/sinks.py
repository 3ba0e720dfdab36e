"""Results as files: labelled features as CSV, model parameters as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = ("camera_name", "reference_date"), mode: str = "overwrite") -> None:
    """CSV with a header, in a folder for each value of the partition columns that df has."""
    keys = [k for k in partition_by if k in df.columns]
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*keys) if keys else writer).csv(path)


def write_parameters(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scaler or mixture parameters. The name of a run goes in the path (functions.naming.model_name)."""
    df.write.mode(mode).parquet(path)
