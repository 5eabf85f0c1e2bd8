"""Rendering of a frame table: background, stretch, saturation, contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Render, Stats
from ..model import FRAME, FRAME_PIXEL
from ..operators import background as B
from ..operators import stats as S
from ..operators import tone as R
from ..session import settle


def _apply(pixels: DataFrame, able: DataFrame, fn) -> DataFrame:
    """Run a stage on the frames that can take it; the others pass unchanged."""
    keys = able.select(*FRAME)
    done = fn(pixels.join(keys, FRAME, "left_semi"))
    return done.select(*FRAME_PIXEL, "v").unionByName(pixels.join(keys, FRAME, "left_anti").select(*FRAME_PIXEL, "v"))


def render(pixels: DataFrame, frames: DataFrame, config: Render = Render(), model=None, boost=None) -> tuple[DataFrame, DataFrame]:
    """(pixels, status): each stage runs on the frames that fit it and is reported per frame.

    Frames of any size are stretched; a background grid needs at least its own size, saturation and
    contrast need colour.  Frames of other than one or three channels keep their pixels, and their status gives the
    ``reason``.  ``model`` and ``boost`` replace the background model and the saturation curve.
    """
    known = frames.filter("channels IN (1, 3)")
    others = frames.filter("channels IS NULL OR channels NOT IN (1, 3)")
    untouched = pixels.join(others.select(*FRAME), FRAME, "left_semi").select(*FRAME_PIXEL, "v")
    sites = F.col("width") * F.col("height")
    px = S.dealt(pixels.join(known.select(*FRAME), FRAME, "left_semi"), known)
    no = F.lit(False)
    colour = F.col("channels") == 3
    can_stretch = sites >= Stats().min_samples
    status = {"background_subtracted": no, "auto_stretched": no, "saturation_boosted": no, "contrast_applied": no}
    if config.background is not None:
        bg = config.background
        able = B.usable(known, bg)
        # the stretch reads its input several times: write the subtracted pixels once
        px = S.dealt(settle(_apply(px, able, lambda p: B.subtract(p, B.estimate(p, able, bg, model), bg))), known)
        status["background_subtracted"] = (F.col("width") >= bg.cols) & (F.col("height") >= bg.rows)
    contrast = config.contrast if config.contrast is not None and not config.contrast.disabled else None
    fused = contrast if config.saturation is None and config.stretch is not None else None
    params = None
    if config.stretch is not None:
        able = known.filter(can_stretch)
        stretched, params = R.auto_stretch(px.join(able.select(*FRAME), FRAME, "left_semi"), able, config.stretch, fused)
        px = stretched.unionByName(px.join(able.select(*FRAME), FRAME, "left_anti").select(*FRAME_PIXEL, "v"))
        px = px if fused is not None and config.saturation is None else S.dealt(settle(px), known)
        status["auto_stretched"] = can_stretch
    if config.saturation is not None:
        px = _apply(px, known.filter(colour), lambda p: R.saturate_frames(p, config.saturation, boost))
        status["saturation_boosted"] = colour
    if contrast is not None:
        # frames whose contrast was folded into the stretch are done
        rest = known.filter(colour) if fused is None else known.filter(colour & ~can_stretch)
        px = _apply(px, rest, lambda p: R.contrast_frames(p, contrast))
        status["contrast_applied"] = colour
    report = known.select(*FRAME, *[c.alias(n) for n, c in status.items()])
    if params is not None:
        report = report.join(params.select(*FRAME, "black_point", "strength"), FRAME, "left")
    odd = others.select(*FRAME, *[no.alias(n) for n in status], F.format_string("%s channels, not one or three", F.col("channels").cast("string")).alias("reason"))
    report = report.withColumn("reason", F.lit(None).cast("string")).unionByName(odd, allowMissingColumns=True)
    return px.select(*FRAME_PIXEL, "v").unionByName(untouched), report
