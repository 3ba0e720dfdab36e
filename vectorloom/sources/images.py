"""Camera images: read as binary files; pictures of telephoto cameras are turned a quarter counter-clockwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def needs_rotation(camera_name: Column) -> Column:
    return F.coalesce(F.lower(camera_name).contains("tele"), F.lit(False))


def rotated(images: DataFrame, content: str = "content", camera: str = "camera_name") -> DataFrame:
    """content turned where the camera needs it. Pillow must be on the executors."""
    import pandas as pd

    @F.pandas_udf("binary")
    def turn(data: pd.Series, turned: pd.Series) -> pd.Series:
        import io

        from PIL import Image

        def one(raw, needs):
            if raw is None or not needs:
                return raw
            picture, out = Image.open(io.BytesIO(raw)), io.BytesIO()
            picture.rotate(90, expand=True).save(out, picture.format or "PNG")
            return out.getvalue()

        return pd.Series([one(a, b) for a, b in zip(data, turned, strict=True)])

    return images.withColumn(content, turn(F.col(content), needs_rotation(F.col(camera))))
