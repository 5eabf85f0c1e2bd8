"""Table function: frame array to pixel rows, for use in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

PIXEL_TYPE = StructType(
    [StructField(c, IntegerType()) for c in ("ch", "y", "x")] + [StructField("v", DoubleType())]
)


@udtf(returnType=PIXEL_TYPE)
class FramePixels:
    """frame_pixels(data, width, channels): one row per sample."""

    def eval(self, data: list, width: int, channels: int) -> Iterator[tuple]:
        for i, v in enumerate(data or []):
            site = i // channels
            yield i % channels, site // width, site % width, float(v)


def register(spark: SparkSession) -> None:
    spark.udtf.register("frame_pixels", FramePixels)
