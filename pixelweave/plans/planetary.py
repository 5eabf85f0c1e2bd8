"""End-to-end lucky imaging and comet stacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Lucky, Rejection
from ..model import FRAME, FRAME_PIXEL
from ..operators import lucky as L
from ..operators import pixels as P
from ..operators import stack as K
from ..operators import warp as W
from ..session import settle


@dataclass(frozen=True)
class LuckyResult:
    stack: DataFrame  # session, ch, y, x, v
    scores: DataFrame  # frame, quality, dx, dy
    selected: DataFrame
    stats: DataFrame


def first_frames(frames: DataFrame) -> DataFrame:
    return frames.groupBy("session").agg(F.min_by("frame_id", "frame_number").alias("frame_id"))


def regions(luminance: DataFrame, frames: DataFrame, config: Lucky) -> DataFrame:
    """Alignment region per frame: around its centroid, or fixed."""
    size = F.greatest(F.floor(F.least("width", "height") / 2), F.lit(64)).cast("int")
    w = F.lit(config.roi[2]) if config.roi else size
    h = F.lit(config.roi[3]) if config.roi else size
    if config.auto_tracking:
        c = L.centroid(luminance, frames).join(frames.select(*FRAME, "width", "height"), FRAME)
        roi = P.roi_centred_at(F.col("cx"), F.col("cy"), w, h, F.col("width"), F.col("height"))
    else:
        c = frames
        x = F.lit(config.roi[0]) if config.roi else F.floor(F.greatest(F.col("width") - size, F.lit(0)) / 2)
        y = F.lit(config.roi[1]) if config.roi else F.floor(F.greatest(F.col("height") - size, F.lit(0)) / 2)
        roi = {"roi_x": x, "roi_y": y, "roi_w": w, "roi_h": h}
    r = c.select(*FRAME, "width", "height", *[v.alias(k) for k, v in roi.items()])
    inside = P.roi_clamped(F.col("roi_x"), F.col("roi_y"), F.col("roi_w"), F.col("roi_h"), F.col("width"), F.col("height"))
    return r.select(*FRAME, *[v.alias(k) for k, v in inside.items()])


def stack_lucky(pixels: DataFrame, frames: DataFrame, config: Lucky = Lucky(), prewarp=None) -> LuckyResult:
    """Score, align, select and stack the frames of every session.

    The first frame of a session is the reference.  ``prewarp(pixels, frames)`` may
    reshape the pixels first.
    """
    if prewarp is not None:
        pixels = prewarp(pixels, frames)
    lum = P.luma_luminance(pixels)
    ref_keys = first_frames(frames)
    reference = lum.join(ref_keys, FRAME, "left_semi").select("session", "y", "x", "v")
    offsets = L.alignment(lum, reference, regions(lum, frames, config), frames, config.search_radius, config.subpixel_factor > 1)
    zero = ref_keys.withColumn("_ref", F.lit(True))
    scores = L.frame_scores(lum, config.metric).join(offsets, FRAME).join(zero, FRAME, "left")
    for c in ("dx", "dy"):
        scores = scores.withColumn(c, F.when(F.col("_ref"), 0.0).otherwise(F.col(c)))
    scores = settle(scores.select(*FRAME, "quality", "dx", "dy", "ncc", "method"))
    pool = L.best_n(scores, config.max_frames).drop("rank") if config.max_frames > 0 else scores
    selected = settle(L.select_best(pool, config))
    moved = W.translate(pixels.join(selected.select(*FRAME), FRAME, "left_semi"), selected, frames)
    return LuckyResult(L.stack_selected(moved, selected, config), scores, selected, L.selection_stats(pool, config))


def comet_centroids(pixels: DataFrame, frames: DataFrame, rois: DataFrame) -> DataFrame:
    """Nucleus per frame inside its region, in frame coordinates: cx, cy, total_flux, snr.

    snr is the flux over the scatter of the region times the root of its pixels.
    """
    lum = P.luma_luminance(pixels)
    cut = P.crop(lum, rois)
    dims = rois.select(*FRAME, F.col("roi_w").alias("width"), F.col("roi_h").alias("height"))
    c = L.centroid(cut, dims).join(rois.select(*FRAME, "roi_x", "roi_y"), FRAME)
    noise = cut.groupBy(*FRAME).agg(F.stddev_pop("v").alias("_s"), F.count("*").alias("_n"))
    c = c.join(noise, FRAME, "left")
    scatter = F.col("_s") * F.sqrt("_n")
    return c.select(
        *FRAME,
        (F.col("cx") + F.col("roi_x")).alias("cx"),
        (F.col("cy") + F.col("roi_y")).alias("cy"),
        "total_flux",
        F.when(scatter > 1e-10, F.col("total_flux") / scatter).otherwise(0.0).alias("snr"),
    )


def stack_comet(
    pixels: DataFrame,
    frames: DataFrame,
    rois: DataFrame,
    rejection: Rejection = Rejection("sigma_clip", 2.0, 2.0),
    tracker=None,
) -> tuple[DataFrame, DataFrame]:
    """(stack, offsets): frames moved so that the nucleus stays put, stars rejected as outliers.

    ``tracker(pixels, frames, rois)`` may supply frame, dx, dy in place of the centroid.
    """
    if tracker is not None:
        offsets = tracker(pixels, frames, rois)
    else:
        c = settle(comet_centroids(pixels, frames, rois))
        ref = c.join(first_frames(frames), FRAME, "left_semi").select("session", F.col("cx").alias("_x"), F.col("cy").alias("_y"))
        offsets = c.join(ref, "session").select(
            *FRAME, "cx", "cy", "total_flux", "snr", (F.col("_x") - F.col("cx")).alias("dx"), (F.col("_y") - F.col("cy")).alias("dy")
        )
    moved = W.translate(pixels.select(*FRAME_PIXEL, "v"), offsets, frames)
    return K.rejected_stack(moved, rejection), offsets
