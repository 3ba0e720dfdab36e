"""The analysis catalog: three tables (analyses, images, cameras) joined on demand.

analyses: dic_id, master_image_id, slave_image_id, master_timestamp, slave_timestamp, reference_date, time_difference_hours
images: image_id, camera_id; cameras: camera_id, camera_name
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.config import Settings


def read_jdbc(spark: SparkSession, settings: Settings, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1) -> DataFrame:
    """A catalog table over JDBC; split into ranges of a numeric column if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=settings.jdbc_url, dbtable=table, user=settings.database.user, password=settings.database.password)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def joined(analyses: DataFrame, images: DataFrame, cameras: DataFrame) -> DataFrame:
    out = analyses.join(images, analyses["master_image_id"] == images["image_id"]).join(cameras, "camera_id")
    return out.drop("image_id")


def analyses_of(catalog: DataFrame, *, reference_date: str | None = None, master_timestamp: str | None = None, camera_id: int | None = None, camera_name: str | None = None, dic_id: int | None = None) -> DataFrame:
    """The catalog rows for which every given condition holds. Order is the caller's: `ordered` sorts by timestamp."""
    out = catalog
    if reference_date is not None:
        out = out.where(F.to_date("reference_date") == F.lit(reference_date).cast("date"))
    if master_timestamp is not None:
        out = out.where(F.to_date("master_timestamp") == F.lit(master_timestamp).cast("date"))
    if camera_id is not None:
        out = out.where(F.col("camera_id") == camera_id)
    if camera_name is not None:
        out = out.where(F.col("camera_name") == camera_name)
    if dic_id is not None:
        out = out.where(F.col("dic_id") == dic_id)
    return out


def ordered(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("master_timestamp", "dic_id")


def head(catalog: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows by master timestamp, then id."""
    return ordered(catalog).limit(n)


def first_analyses(catalog: DataFrame, *keys: str) -> DataFrame:
    """The first analysis by master timestamp, then id, of each key; of all without keys."""
    if not keys:
        return ordered(catalog).limit(1)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("master_timestamp", "dic_id"))
    return catalog.withColumn("__n", rank).where("__n = 1").drop("__n")


def work_list(catalog: DataFrame, cameras: Sequence[str] | None = None) -> DataFrame:
    """The distinct (reference_date, camera_name), of the given cameras if any, in this order."""
    out = catalog.select(F.to_date("reference_date").alias("reference_date"), "camera_name")
    if cameras:
        out = out.where(F.col("camera_name").isin(list(cameras)))
    return out.distinct().orderBy("reference_date", "camera_name")


def tasks(work: DataFrame) -> DataFrame:
    return work.orderBy("camera_name", "reference_date")


def dates_by_camera(work: DataFrame) -> DataFrame:
    """camera_name and its dates, sorted: as many as a camera has days."""
    return work.groupBy("camera_name").agg(F.sort_array(F.collect_set("reference_date")).alias("dates"))


def date_scan(results: DataFrame, analyses: DataFrame, day: str) -> DataFrame:
    """The older layout: results (analysis_id, seed and displacement columns) of the analyses (id) of one day, by seed."""
    own = analyses.where(F.to_date("master_timestamp") == F.lit(day).cast("date"))
    return results.join(own, results["analysis_id"] == own["id"]).orderBy("seed_x_px", "seed_y_px")
