"""Column sets and schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

FRAME = ["session", "frame_id"]
PIXEL = ["session", "ch", "y", "x"]
FRAME_PIXEL = ["session", "frame_id", "ch", "y", "x"]
SITE = ["session", "frame_id", "y", "x"]

FRAMES_SCHEMA = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("frame_number", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("exposure_s", T.DoubleType()),
        T.StructField("gain", T.IntegerType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("camera", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("stacked_frames", T.LongType()),
        T.StructField("software", T.StringType()),
        T.StructField("binning", T.IntegerType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("set_temp_c", T.DoubleType()),
        T.StructField("cfa_pattern", T.StringType()),
    ]
)

PIXELS_SCHEMA = "session string, frame_id bigint, ch int, y int, x int, v double"
STARS_SCHEMA = (
    "session string, frame_id bigint, star_idx int, x double, y double, "
    "flux double, peak double, snr double, fwhm double"
)
TRANSFORMS_SCHEMA = (
    "session string, frame_id bigint, rotation double, scale double, tx double, ty double, "
    "matched int, residual double, config string, status string, reason string"
)
STACK_SCHEMA = "session string, segment int, ch int, y int, x int, w double, mean double, m2 double, n bigint"
BG_NODES_SCHEMA = (
    "session string, frame_id bigint, ch int, row int, col int, nx int, ny int, value double"
)
