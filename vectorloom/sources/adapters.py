"""The engine's tables from TPC-H-like ones: orders as analyses, customers as images, nations as cameras, line items as fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.sources import catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("dic_id"), F.col("o_custkey").alias("master_image_id"), F.col("o_orderdate").alias("master_timestamp"), F.col("o_orderdate").alias("reference_date"), F.col("o_orderstatus").alias("state"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_nationkey").alias("camera_id"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("camera_id"), F.col("n_name").alias("camera_name"))


def joined_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.joined(analyses(spark, sf_dir), images(spark, sf_dir), cameras(spark, sf_dir))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, u, v, speed: a frame a year, on a grid of 16 pixels; one row a cell."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("frame"), "l_partkey", "l_quantity", "l_linenumber")
    keys = ["frame", ((F.col("l_partkey") % 40) * 16).cast("double").alias("x"), (F.floor(F.col("l_partkey") / 40) * 16).cast("double").alias("y")]
    n = F.count(F.lit(1))
    u = (F.sum("l_quantity") - 25 * n) / 8.0
    v = (F.sum(F.col("l_linenumber").cast("double") * 8) - 32 * n) / 8.0
    out = rows.groupBy(*keys).agg(u.alias("u"), v.alias("v"))
    return out.withColumn("speed", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
