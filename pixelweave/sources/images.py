"""Folders of 8-bit images through Spark's own image source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..model import FRAME
from ..operators.pixels import explode_frames


@F.pandas_udf(ArrayType(DoubleType()))
def _values(data: pd.Series, bands: pd.Series) -> pd.Series:
    """Interleaved values in red-green-blue order (or grey); a fourth band is alpha and goes."""
    out = []
    for raw, n in zip(data, bands):
        a = np.frombuffer(raw, dtype="u1").reshape(-1, n)
        out.append((a[:, 2::-1] if n >= 3 else a).reshape(-1) / 255.0)
    return pd.Series(out)


def image_frames(spark: SparkSession, path: str, session: str = "images") -> DataFrame:
    """One row per readable image under ``path`` with interleaved ``data``; alpha is dropped.

    Spark stores bytes in blue-green-red order.  frame_id hashes the file name, and
    ordering by ``path`` gives the order by name.
    """
    img = spark.read.format("image").load(path).filter("image.nChannels > 0")
    return img.select(
        F.lit(session).alias("session"),
        F.xxhash64("image.origin").alias("frame_id"),
        F.col("image.origin").alias("path"),
        "image.width",
        "image.height",
        F.when(F.col("image.nChannels") == 1, 1).otherwise(3).alias("channels"),
        _values("image.data", "image.nChannels").alias("data"),
    )


def image_rejects(spark: SparkSession, path: str, session: str = "images") -> DataFrame:
    """session, path and reason of the files under ``path`` that could not be read as images."""
    bad = spark.read.format("image").load(path).filter("image.nChannels <= 0")
    return bad.select(F.lit(session).alias("session"), F.col("image.origin").alias("path"), F.lit("not a readable image").alias("reason"))


def image_pixels(spark: SparkSession, path: str, session: str = "images") -> tuple[DataFrame, DataFrame]:
    """(pixels, frames) of the images under ``path``."""
    f = image_frames(spark, path, session)
    return explode_frames(f), f.select(*FRAME, "path", "width", "height", "channels")
