"""Shape of frames: arrays to pixels and back, luminance, down-sampling, regions, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp01, luma_weight, quantise8, quantise8_round
from ..model import FRAME, FRAME_PIXEL, SITE


def explode_frames(frames: DataFrame, array: str = "data", carry: list[str] | None = None) -> DataFrame:
    """One row per sample of an interleaved row-major array: index = (y*w + x)*ch + c."""
    carry = carry or []
    e = frames.select(*FRAME, *carry, "width", "channels", F.posexplode(array).alias("_i", "_v"))
    site = F.floor(F.col("_i") / F.col("channels"))
    return e.select(
        *FRAME,
        *carry,
        (F.col("_i") % F.col("channels")).cast("int").alias("ch"),
        F.floor(site / F.col("width")).cast("int").alias("y"),
        (site % F.col("width")).cast("int").alias("x"),
        F.col("_v").cast("double").alias("v"),
    )


def with_index(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Add the interleaved sample index ``idx`` from the frame dimensions."""
    dims = frames.select(*FRAME, "width", "channels")
    return pixels.join(dims, FRAME).withColumn(
        "idx", (F.col("y") * F.col("width") + F.col("x")).cast("long") * F.col("channels") + F.col("ch")
    )


def collect_frames(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels back to one array per frame, with ``complete`` = length matches the dimensions.

    A group is one frame, bounded by its sensor.
    """
    arrays = (
        with_index(pixels, frames)
        .groupBy(*FRAME)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "v"))), lambda s: s["v"]).alias("data"))
    )
    dims = frames.select(*FRAME, "width", "height", "channels")
    expected = F.col("width") * F.col("height") * F.col("channels")
    return dims.join(arrays, FRAME, "left").withColumn("complete", F.coalesce(F.size("data") == expected, F.lit(False)))


def mean_luminance(pixels: DataFrame) -> DataFrame:
    """Channel mean per site."""
    return pixels.groupBy(*SITE).agg(F.avg("v").alias("v"))


def luma_luminance(pixels: DataFrame) -> DataFrame:
    """Weighted luminance of three channels; a mono frame keeps its value.

    A site has at most one row per channel, so the sums merge on the map side.
    """
    g = pixels.groupBy(*SITE).agg(
        F.sum(luma_weight(F.col("ch")) * F.col("v")).alias("_l"),
        F.max("ch").alias("_top"),
        F.sum("v").alias("_s"),
    )
    return g.select(*SITE, F.when(F.col("_top") == 0, F.col("_s")).otherwise(F.col("_l")).alias("v"))


def clamp_values(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", clamp01(F.col("v")))


def to_8bit(pixels: DataFrame, half_up: bool = True) -> DataFrame:
    return pixels.withColumn("u8", (quantise8 if half_up else quantise8_round)(F.col("v")))


def drop_nan(pixels: DataFrame) -> DataFrame:
    return pixels.filter(~F.isnan("v"))


def normalise_frames(pixels: DataFrame) -> DataFrame:
    """Per frame: subtract the minimum, divide by the range (at least 1e-10)."""
    limits = pixels.groupBy(*FRAME).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    scale = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-10))
    return pixels.join(limits, FRAME).select(*pixels.columns[:-1], ((F.col("v") - F.col("_lo")) / scale).alias("v"))


def area_downsample(pixels: DataFrame, frames: DataFrame, factor: int) -> DataFrame:
    """Mean of factor x factor blocks; trailing rows and columns are dropped.

    Frames smaller than the factor give no rows.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1")
    dims = frames.select(*FRAME, "width", "height")
    j = pixels.join(dims, FRAME)
    y, x = F.floor(F.col("y") / factor).cast("int"), F.floor(F.col("x") / factor).cast("int")
    inside = (y < F.floor(F.col("height") / factor)) & (x < F.floor(F.col("width") / factor))
    return (
        j.filter(inside).groupBy(*FRAME, "ch", y.alias("y"), x.alias("x")).agg(F.avg("v").alias("v"))
    )


def fit_box(width: Column, height: Column, max_w: int, max_h: int) -> tuple[Column, Column]:
    """Target size inside a bounding box, aspect kept, never enlarged."""
    aspect = width / height
    wide = (width / max_w) > (height / max_h)
    tw = F.when(wide, F.lit(max_w)).otherwise(F.floor(max_h * aspect))
    th = F.when(wide, F.floor(max_w / aspect)).otherwise(F.lit(max_h))
    small = (width <= max_w) & (height <= max_h)
    return (
        F.when(small, width).otherwise(F.greatest(tw, F.lit(1))).cast("int"),
        F.when(small, height).otherwise(F.greatest(th, F.lit(1))).cast("int"),
    )


def box_downsample(pixels: DataFrame, frames: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """Box filter to a bounding box.

    Target column t covers source columns [floor(t*s), floor((t+1)*s)), so a source
    column belongs to the largest t with floor(t*s) <= x; no join on ranges is needed.
    """
    tw, th = fit_box(F.col("width"), F.col("height"), max_w, max_h)
    dims = frames.select(*FRAME, "width", "height").withColumn("tw", tw).withColumn("th", th)
    j = pixels.join(dims, FRAME)

    def target(pos: str, size: str, out: str) -> Column:
        scale = F.col(size) / F.col(out)
        guess = F.floor(F.col(pos) / scale).cast("int")
        upper = guess + 1
        return F.when(F.floor(upper * scale) <= F.col(pos), upper).otherwise(guess)

    t = j.withColumn("ty", target("y", "height", "th")).withColumn("tx", target("x", "width", "tw"))
    return (
        t.filter((F.col("ty") < F.col("th")) & (F.col("tx") < F.col("tw")))
        .groupBy(*FRAME, "ch", F.col("ty").alias("y"), F.col("tx").alias("x"))
        .agg(F.avg("v").alias("v"))
    )


def check_dimensions(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """Mark frames whose size differs from their session's reference.

    ``reference`` has one row per session: session, width, height, channels.
    """
    ref = reference.select(
        "session", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("channels").alias("_c")
    )
    same = (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h")) & (F.col("channels") == F.col("_c"))
    text = F.format_string(
        "frame is %dx%dx%d, session has %dx%dx%d", "width", "height", "channels", "_w", "_h", "_c"
    )
    return (
        frames.join(ref, "session", "left")
        .withColumn("accepted", F.coalesce(same, F.lit(False)))
        .withColumn(
            "reason", F.when(F.col("_w").isNull(), F.lit("No reference")).when(~F.col("accepted"), text)
        )
        .drop("_w", "_h", "_c")
    )


def split_by_dimensions(frames: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_dimensions(frames, reference)
    return (
        checked.filter("accepted").drop("accepted", "reason"),
        checked.filter(~F.col("accepted")).drop("accepted"),
    )


def roi_centred(width: Column, height: Column, size: int) -> dict[str, Column]:
    def start(edge: Column) -> Column:
        return F.floor(F.greatest(edge - size, F.lit(0)) / 2).cast("int")

    return {
        "roi_x": start(width),
        "roi_y": start(height),
        "roi_w": F.least(F.lit(size), width).cast("int"),
        "roi_h": F.least(F.lit(size), height).cast("int"),
    }


def roi_centred_at(cx: Column, cy: Column, roi_w, roi_h, width: Column, height: Column) -> dict[str, Column]:
    roi_w = roi_w if isinstance(roi_w, Column) else F.lit(roi_w)
    roi_h = roi_h if isinstance(roi_h, Column) else F.lit(roi_h)
    x = F.floor(F.greatest(cx - roi_w / 2.0, F.lit(0.0))).cast("int")
    y = F.floor(F.greatest(cy - roi_h / 2.0, F.lit(0.0))).cast("int")
    return {
        "roi_x": x,
        "roi_y": y,
        "roi_w": F.least(roi_w, F.greatest(width - x, F.lit(0))).cast("int"),
        "roi_h": F.least(roi_h, F.greatest(height - y, F.lit(0))).cast("int"),
    }


def roi_clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Move a region into the frame, then cut it to the frame."""
    rx = F.least(x, F.greatest(width - w, F.lit(0)))
    ry = F.least(y, F.greatest(height - h, F.lit(0)))
    return {
        "roi_x": rx.cast("int"),
        "roi_y": ry.cast("int"),
        "roi_w": F.least(w, width - rx).cast("int"),
        "roi_h": F.least(h, height - ry).cast("int"),
    }


def crop(pixels: DataFrame, rois: DataFrame) -> DataFrame:
    """Keep the pixels of each frame's region; coordinates become relative to it."""
    j = pixels.join(rois.select(*FRAME, "roi_x", "roi_y", "roi_w", "roi_h"), FRAME)
    y, x = F.col("y") - F.col("roi_y"), F.col("x") - F.col("roi_x")
    inside = (y >= 0) & (x >= 0) & (y < F.col("roi_h")) & (x < F.col("roi_w"))
    cols = [c for c in pixels.columns if c not in ("y", "x")]
    return j.filter(inside).select(*cols, y.alias("y"), x.alias("x"))


def strided_sample(pixels: DataFrame, frames: DataFrame, max_samples: int | None = None, min_samples: int = 0) -> DataFrame:
    """Keep every ``step``-th site, step = total div min(total, max_samples); every site without ``max_samples``.

    Frames with fewer than ``min_samples`` sites give no rows.
    """
    sites = (F.col("width") * F.col("height")).cast("long")
    if max_samples is None:
        return pixels.join(frames.filter(sites >= min_samples).select(*FRAME), FRAME, "left_semi").select(*pixels.columns)
    step = F.greatest(F.floor(sites / F.least(sites, F.lit(max_samples))), F.lit(1))
    dims = frames.select(*FRAME, "width", "height").withColumn("_step", step).withColumn("_sites", sites)
    j = pixels.join(dims.filter(F.col("_sites") >= min_samples), FRAME)
    index = F.col("y").cast("long") * F.col("width") + F.col("x")
    return j.filter(index % F.col("_step") == 0).select(*pixels.columns)


def complete_grid(pixels: DataFrame, frames: DataFrame, fill: float) -> DataFrame:
    """Outer join to the full grid of each frame; missing pixels get ``fill``."""
    ch = F.explode(F.sequence(F.lit(0), F.col("channels") - 1)).alias("ch")
    grid = frames.select(*FRAME, "width", "height", ch)
    grid = grid.select(*FRAME, "width", "ch", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    grid = grid.select(*FRAME, "ch", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return grid.join(pixels.select(*FRAME_PIXEL, "v"), FRAME_PIXEL, "left").withColumn(
        "v", F.coalesce("v", F.lit(fill))
    )
