"""Raw sample bytes to values, and the partitioned Parquet layout of sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..config import PIXEL_FORMATS
from ..model import FRAME


@F.pandas_udf(ArrayType(DoubleType()))
def _decode(content: pd.Series, pixel_format: pd.Series) -> pd.Series:
    out = []
    for raw, fmt in zip(content, pixel_format):
        size, top = PIXEL_FORMATS[fmt]
        dtype = "u1" if size == 1 else (">u2" if fmt.endswith("Be") else "<u2")
        out.append(np.frombuffer(raw, dtype=dtype).astype("float64") / top)
    return pd.Series(out)


def decode_raw(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames with ``data``, rejects with ``reason``) from content BINARY and pixel_format.

    The length must be width * height * channels * bytes per sample.
    """
    sizes = F.create_map(*[F.lit(v) for k, (b, _) in PIXEL_FORMATS.items() for v in (k, b)])
    expected = F.col("width") * F.col("height") * F.col("channels") * sizes[F.col("pixel_format")]
    text = F.format_string("Invalid data size: expected %d bytes, got %d", expected, F.length("content"))
    reason = F.when(expected.isNull(), F.concat(F.lit("Unknown pixel format: "), F.coalesce("pixel_format", F.lit("none")))).when(
        expected != F.length("content"), text
    )
    checked = frames.withColumn("reason", reason)
    good = checked.filter("reason IS NULL").withColumn("data", _decode("content", "pixel_format"))
    return good.drop("content", "reason"), checked.filter("reason IS NOT NULL").select(*FRAME, "reason")


KINDS = ("raw", "stacked", "planetary")


def save_session(df: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Parquet partitioned by session and kind.

    Rows are clustered by session and frame so that a task writes few folders; a large
    session still spreads over many files.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    keys = [c for c in ("session", "frame_id", "ch", "y") if c in df.columns]
    out = df.withColumn("kind", F.lit(kind)).repartition(*[F.col(k) for k in keys])
    writer = out.write.partitionBy("session", "kind").mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def load_session(spark: SparkSession, path: str, kind: str, session: str | None = None) -> DataFrame:
    """Stored rows of a kind; partition filters prune the folders that are read."""
    df = spark.read.parquet(path).filter(F.col("kind") == kind)
    return df if session is None else df.filter(F.col("session") == session)
