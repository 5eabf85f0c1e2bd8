"""End-to-end stack of many sessions: detect, register, warp, weigh, stack."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DeepSky
from ..model import FRAME, FRAME_PIXEL
from ..operators import detect as T
from ..operators import pixels as P
from ..operators import register as G
from ..operators import stack as K
from ..operators import warp as W
from ..session import settle


@dataclass(frozen=True)
class StackResult:
    stack: DataFrame  # session, ch, y, x, w, mean, m2, n, coverage
    verdicts: DataFrame  # one row per frame
    stats: DataFrame  # one row per session
    transforms: DataFrame
    stars: DataFrame


def pick_references(frames: DataFrame, star_counts: DataFrame, min_stars: int) -> DataFrame:
    """First frame of each session with at least ``min_stars`` stars."""
    j = frames.join(star_counts.filter(F.col("stars") >= min_stars), FRAME)
    g = j.groupBy("session").agg(F.min_by(F.struct("frame_id", "width", "height", "channels"), "frame_number").alias("_r"))
    return g.select("session", "_r.*")


def stack_sessions(pixels: DataFrame, frames: DataFrame, config: DeepSky = DeepSky()) -> StackResult:
    """Stack every session of ``pixels`` (calibrated, debayered) onto its own reference frame.

    Stars and transforms are a few rows per frame and are written out once; pixels are
    read for detection and again for the warp and meet one exchange in each.
    """
    luminance = P.mean_luminance(pixels)
    found = T.detect_adaptive(luminance, frames) if config.detection is None else T.detect(luminance, frames, config.detection)
    stars = settle(found.select(*T.STAR))
    quality = T.frame_medians(stars)
    references = settle(pick_references(frames, quality, config.min_stars))
    checked = P.check_dimensions(frames, references)
    ref_keys = references.select(*FRAME)
    enough = quality.filter(F.col("stars") >= config.min_stars).select(*FRAME)
    todo = (
        checked.filter("accepted").select(*FRAME).join(enough, FRAME, "left_semi").join(ref_keys, FRAME, "left_anti")
    )
    found = settle(G.register(stars, ref_keys, todo, config.cascade, config.hints))
    placed = found.filter("status = 'ok'")
    moved = W.warp(pixels, placed, frames)
    aligned = moved.unionByName(pixels.join(ref_keys, FRAME, "left_semi").select(*FRAME_PIXEL, "v"))
    identity = ref_keys.select(
        *FRAME,
        *[F.lit(v).alias(c) for c, v in (("rotation", 0.0), ("scale", 1.0), ("tx", 0.0), ("ty", 0.0))],
        F.lit(None).cast("int").alias("matched"),
        F.lit(None).cast("double").alias("residual"),
        F.lit(None).cast("string").alias("config"),
        F.lit(0).alias("attempts"),
        F.lit("reference").alias("status"),
        F.lit(None).cast("string").alias("reason"),
    )
    transforms = found.select(*identity.columns).unionByName(identity)
    stacked = transforms.filter("status IN ('ok', 'reference')").select(*FRAME)
    ranked = frames.select(*FRAME, "frame_number").join(stacked, FRAME, "left_semi").join(quality.select(*FRAME, "fwhm", "snr"), FRAME)
    weights = settle(K.quality_weights(ranked, config.weighting).select(*FRAME, "weight"))
    counts = weights.groupBy("session").agg(F.count("*").alias("frames"))
    image = K.coverage(K.rejected_stack(aligned, config.rejection, weights), counts)
    verdict = settle(K.verdicts(frames, checked, quality, transforms, config.min_stars))
    return StackResult(image, verdict, K.stacking_stats(verdict), transforms, stars)
