"""Colour and tone: white balance, black points, stretches, contrast and 8-bit output."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import Contrast, Saturation, Stats, Stretch
from ..functions.columns import asinh_stretch, clamp, clamp01, dither_offset, luma, mtf, s_curve, saturation_gain, solve_midtone
from ..functions.solve import newton_factor
from ..model import FRAME, FRAME_PIXEL, SITE
from ..session import settle
from . import stats as S

DARK = 1e-8


# ---- channels side by side ---------------------------------------------------------


def to_rgb(pixels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per site with r, g, b; colour frames only. ``carry`` keeps per-frame columns.

    The three rows of a site come from one frame, so the map side already merges them.
    """
    pick = lambda c: F.max(F.when(F.col("ch") == c, F.col("v")))
    return pixels.groupBy(*SITE).agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"), *[F.first(c).alias(c) for c in carry])


def from_rgb(rgb: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("ch"), F.col(c).alias("v")) for i, c in enumerate("rgb")])
    return rgb.select(*SITE, F.explode(rows).alias("_c")).select(*FRAME, "_c.ch", "y", "x", "_c.v")


def map_rgb(rgb: DataFrame, fn) -> DataFrame:
    """Replace r, g, b by ``fn(r, g, b)``."""
    r, g, b = fn(F.col("r"), F.col("g"), F.col("b"))
    others = [c for c in rgb.columns if c not in ("r", "g", "b")]
    return rgb.select(*others, r.alias("r"), g.alias("g"), b.alias("b"))


def keep_colour(curve, intensity: Column | float = 1.0):
    """Scale colours by curve(L)/L; ``intensity`` mixes between grey (0) and colour (1)."""

    def fn(r: Column, g: Column, b: Column):
        lum = luma(r, g, b)
        k = intensity if isinstance(intensity, Column) else F.lit(float(intensity))
        out = curve(lum)
        scale = out / lum
        return tuple(F.when(lum <= DARK, F.lit(0.0)).otherwise(clamp01(v * scale * k + out * (1.0 - k))) for v in (r, g, b))

    return fn


# ---- white balance -------------------------------------------------------------------


def neutral_multipliers(stats: DataFrame) -> DataFrame:
    """average(medians)/median per channel, within [0.5, 2]. Colour frames only."""
    avg = stats.groupBy(*FRAME).agg(F.avg("median").alias("_avg"), F.count("*").alias("_n")).filter("_n = 3")
    j = stats.join(avg, FRAME)
    m = F.when(F.col("median") > 1e-6, F.col("_avg") / F.col("median")).otherwise(1.0)
    return j.select(*FRAME, "ch", clamp(m, 0.5, 2.0).alias("multiplier"))


def apply_multipliers(pixels: DataFrame, multipliers: DataFrame) -> DataFrame:
    j = pixels.join(multipliers, [*FRAME, "ch"])
    return j.withColumn("v", clamp01(F.col("v") * F.col("multiplier"))).select(*pixels.columns)


def grid_white_balance(pixels: DataFrame, frames: DataFrame, grid: int, percentile: float) -> DataFrame:
    """Multipliers from block medians: green divided by the block value at the percentile.

    Blocks are (w div grid) x (h div grid), the last row and column take the remainder;
    the element taken is floor(p/100 * n) of the ascending block medians.
    """
    grid = max(grid, 1)
    dims = frames.filter("channels = 3").select(*FRAME, F.floor(F.col("width") / grid).alias("_bw"), F.floor(F.col("height") / grid).alias("_bh"))
    j = pixels.join(dims.filter("_bw > 0 AND _bh > 0"), FRAME)
    block = [F.least(F.floor(F.col(p) / F.col(s)), F.lit(grid - 1)).alias(n) for p, s, n in (("y", "_bh", "_gy"), ("x", "_bw", "_gx"))]
    keys = [*FRAME, "ch", "_gy", "_gx"]
    # counts of distinct values and windows that spill: a block of a large sensor is no buffer
    counts = S.value_counts(j.select(*FRAME, "ch", *block, "v"), keys, "v", S.tasks_for(frames))
    med = S.with_median(counts, keys, "v", "_n", "m").groupBy(*keys).agg(F.min("m").alias("m"))
    n = grid * grid
    index = min(int(percentile / 100.0 * n), n - 1)
    # a frame has grid*grid blocks, a fixed number
    levels = med.groupBy(*FRAME, "ch").agg(F.element_at(F.sort_array(F.collect_list("m")), index + 1).alias("_level"))
    green = levels.filter("ch = 1").select(*FRAME, F.greatest("_level", F.lit(1e-6)).alias("_green"))
    m = F.when(F.col("ch") == 1, 1.0).when(F.col("_level") > 1e-6, F.col("_green") / F.col("_level")).otherwise(1.0)
    out = levels.join(green, FRAME).select(*FRAME, "ch", clamp(m, 0.5, 2.0).alias("multiplier"))
    small = frames.join(dims.filter("_bw = 0 OR _bh = 0"), FRAME, "left_semi")
    ones = small.select(*FRAME, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ch"), F.lit(1.0).alias("multiplier"))
    return out.unionByName(ones)


# ---- black points -----------------------------------------------------------------------


def channel_black_points(pixels: DataFrame, frames: DataFrame, stats: DataFrame, k: float = 2.0) -> DataFrame:
    mode = S.channel_mode(pixels, frames)
    bp = F.greatest(F.col("mode") - k * F.col("sigma"), F.lit(0.0))
    return stats.join(mode, [*FRAME, "ch"]).select(*FRAME, "ch", bp.alias("black_point"))


def luminance_black_point(pixels: DataFrame, frames: DataFrame, stats: DataFrame, k: float = 2.0) -> DataFrame:
    mode = S.background_mode(pixels, frames)
    sigma = stats.groupBy(*FRAME).agg(F.avg("sigma").alias("_s"))
    return mode.join(sigma, FRAME).select(*FRAME, F.greatest(F.col("mode") - k * F.col("_s"), F.lit(0.0)).alias("black_point"))


def subtract_black_point(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """Subtract and floor at 0; ``points`` is per frame, or per frame and channel.

    A uniform black point of exactly 0 leaves the frame untouched.
    """
    per_channel = "ch" in points.columns
    keys = [*FRAME, "ch"] if per_channel else FRAME
    j = pixels.join(points.select(*keys, "black_point"), keys)
    v = F.greatest(F.col("v") - F.col("black_point"), F.lit(0.0))
    v = v if per_channel else F.when(F.col("black_point") == 0.0, F.col("v")).otherwise(v)
    return j.withColumn("v", v).select(*pixels.columns)


# ---- stretches ---------------------------------------------------------------------------


def _tone_curve(tone: str, strength: Column):
    if tone == "asinh":
        return lambda v: asinh_stretch(v, strength)
    return lambda v: mtf(v, strength)


def stretch_mono(v: Column, tone: str, strength: Column) -> Column:
    if tone == "asinh":
        out = F.when(v <= DARK, F.lit(0.0)).otherwise(clamp01(asinh_stretch(v, strength)))
        return F.when(strength <= 0.0, v).otherwise(out)
    return F.when(F.abs(strength - 0.5) < 1e-6, v).otherwise(clamp01(mtf(v, strength)))


def stretch_frames(
    pixels: DataFrame,
    strengths: DataFrame,
    tone: str = "asinh",
    color_intensity: float = 1.0,
    contrast: Contrast | None = None,
) -> DataFrame:
    """Tone-map frames of one or three channels; others keep their values. ``strengths``: frame, channels, strength.

    Contrast, when given, is folded into the colour curve, as one pass.
    """
    s = strengths.select(*FRAME, "channels", "strength")
    j = pixels.join(s, FRAME)
    k = F.col("strength")
    mono = j.filter("channels = 1").withColumn("v", stretch_mono(F.col("v"), tone, k)).select(*FRAME_PIXEL, "v")
    # the strength rides along in the aggregation, so the sites need no second join
    rgb = to_rgb(j.filter("channels = 3"), ("strength",))
    curve = _tone_curve(tone, k)
    full = (lambda lum: s_curve(curve(lum), contrast)) if contrast else curve
    colour = from_rgb(map_rgb(rgb, keep_colour(full, color_intensity)).select(*SITE, "r", "g", "b"))
    others = j.filter("channels IS NULL OR channels NOT IN (1, 3)").select(*FRAME_PIXEL, "v")
    return mono.unionByName(colour.select(*FRAME_PIXEL, "v")).unionByName(others)


def contrast_frames(pixels: DataFrame, contrast: Contrast = Contrast()) -> DataFrame:
    """S-curve on the luminance of colour frames."""
    if contrast.disabled:
        return pixels
    return from_rgb(map_rgb(to_rgb(pixels), keep_colour(lambda lum: s_curve(lum, contrast)))).select(*FRAME_PIXEL, "v")


def saturate_frames(pixels: DataFrame, config: Saturation = Saturation(), boost=None) -> DataFrame:
    """Boost colour in the shadows: chroma about L times 1 + strength*L/peak*(1-L/upper)^2.

    ``boost(luminance) -> gain`` replaces the built-in curve.
    """
    gain_of = boost or (lambda lum: saturation_gain(lum, config.strength, config.shadow_peak, config.upper_limit))

    def fn(r: Column, g: Column, b: Column):
        lum = luma(r, g, b)
        gain = gain_of(lum)
        return tuple(clamp01(lum + (v - lum) * gain) for v in (r, g, b))

    return from_rgb(map_rgb(to_rgb(pixels), fn)).select(*FRAME_PIXEL, "v")


# ---- automatic stretch -------------------------------------------------------------------------


def bisect_factor(median: Column, target: Column, config: Stretch) -> Column:
    """asinh factor with f(median) = target by bisection, folded over a fixed number of steps."""
    tol = F.lit(config.tolerance)
    start = F.struct(
        F.lit(config.min_stretch).alias("lo"), F.lit(config.max_stretch).alias("hi"), F.lit(None).cast("double").alias("hit")
    )

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        out = F.asinh(mid * median) / F.asinh(mid)
        low = out < target
        lo, hi = F.when(low, mid).otherwise(acc["lo"]), F.when(low, acc["hi"]).otherwise(mid)
        found = (F.abs(out - target) < tol) | ((hi - lo) / mid < tol)
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.coalesce(acc["hit"], F.when(found, mid)).alias("hit"))

    solved = F.aggregate(
        F.sequence(F.lit(1), F.lit(config.max_iterations)), start, step, lambda a: F.coalesce(a["hit"], (a["lo"] + a["hi"]) / 2.0)
    )
    return (
        F.when((median <= 0.0) | (median >= 1.0) | (target <= 0.0) | (target >= 1.0), F.lit(1.0))
        .when(median >= target, F.lit(config.min_stretch))
        .otherwise(solved)
    )


def estimate_factor(median: Column, target: Column) -> Column:
    """Twenty bisection steps on [0.1, 100]."""

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        low = F.asinh(mid * median) / F.asinh(mid) < target
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.1).alias("lo"), F.lit(100.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, step, lambda a: (a["lo"] + a["hi"]) / 2.0)


def stretch_parameters(pixels: DataFrame, frames: DataFrame, config: Stretch = Stretch(), stats: DataFrame | None = None) -> DataFrame:
    """Black point, effective median, target and strength per frame."""
    stats = S.image_stats(pixels, frames, Stats()) if stats is None else stats
    sigma = stats.groupBy(*FRAME).agg(F.avg("sigma").alias("sigma"))
    # every sample, read three times below
    samples = S.dealt(settle(S.background_samples(pixels, frames)), frames)
    levels = S.mode_of_samples(samples).join(sigma, FRAME)
    share = S.signal_fraction(samples, levels)
    p = levels.join(share, FRAME)
    k, frac = config.black_point_sigma, F.col("signal_fraction")
    adaptive = F.when(frac > C.STRONG_SIGNAL, max(k * C.STRONG_SIGMA, C.STRONG_SIGMA_LEAST)).when(frac > C.SOME_SIGNAL, k * C.SOME_SIGMA).otherwise(k)
    p = p.withColumn("_bp", F.greatest(F.col("mode") - adaptive * F.col("sigma"), F.lit(0.0)))
    adjusted = F.col("mode") - F.col("_bp")
    faint = adjusted < C.FAINT_LEVEL
    p = p.withColumn("black_point", F.when(faint, 0.0).otherwise(F.col("_bp")))
    p = p.withColumn("effective_median", F.greatest(F.when(faint, F.col("mode")).otherwise(adjusted), F.lit(C.LEAST_LEVEL)))
    t = config.target_background
    p = p.withColumn("target", F.when(frac > C.STRONG_SIGNAL, min(t * C.STRONG_TARGET, C.STRONG_TARGET_MOST)).otherwise(t))
    if config.tone == "asinh":
        # one row per frame: vectorised Newton steps
        strength = newton_factor(config)(F.col("effective_median"), F.col("target"))
    else:
        strength = solve_midtone(F.col("effective_median"), F.col("target"))
    return p.withColumn("strength", strength).select(
        *FRAME, "mode", "sigma", "signal_fraction", "black_point", "effective_median", "target", "strength"
    )


def auto_stretch(
    pixels: DataFrame, frames: DataFrame, config: Stretch = Stretch(), contrast: Contrast | None = None
) -> tuple[DataFrame, DataFrame]:
    """(stretched pixels, parameters per frame). Frames of other than one or three channels keep their pixels."""
    others = frames.filter("channels IS NULL OR channels NOT IN (1, 3)").select(*FRAME)
    untouched = pixels.join(others, FRAME, "left_semi").select(*FRAME_PIXEL, "v")
    pixels, frames = pixels.join(others, FRAME, "left_anti"), frames.filter("channels IN (1, 3)")
    stats = S.image_stats(pixels, frames, Stats())
    params = stretch_parameters(pixels, frames, config, stats)
    strengths = params.join(frames.select(*FRAME, "channels"), FRAME)
    if config.per_channel_black_point:
        colour = frames.filter("channels = 3")
        per_channel = channel_black_points(pixels, frames, stats, config.black_point_sigma).join(colour.select(*FRAME), FRAME, "left_semi")
        mono = params.join(frames.filter("channels = 1").select(*FRAME), FRAME, "left_semi").select(*FRAME, F.lit(0).alias("ch"), "black_point")
        cut = subtract_black_point(pixels, per_channel.unionByName(mono))
    else:
        cut = subtract_black_point(pixels, params)
    return stretch_frames(cut, strengths, config.tone, config.color_intensity, contrast).unionByName(untouched), params


# ---- output ----------------------------------------------------------------------------------------


def to_output8(pixels: DataFrame, contrast: Contrast | None = None, gamma: float = 1.0, dither: bool = False) -> DataFrame:
    """Contrast, gamma (through 256 levels), rounding to 8 bit, optional ordered dither."""
    rgb = to_rgb(pixels)
    if contrast is not None and not contrast.disabled:
        curve = keep_colour(lambda lum: s_curve(lum, contrast))

        def with_dark(r, g, b):
            dark = luma(r, g, b) <= DARK
            return tuple(F.when(dark, v).otherwise(o) for v, o in zip((r, g, b), curve(r, g, b)))

        rgb = map_rgb(rgb, with_dark)
    gamma = min(max(gamma, 0.1), 3.0)

    def level(v: Column) -> Column:
        return clamp(F.round(v * 255.0), 0.0, 255.0)

    def out(v: Column) -> Column:
        if abs(gamma - 1.0) > 1e-6:
            v = F.pow(level(v) / 255.0, F.lit(1.0 / gamma))
        u = level(v).cast("int")
        return clamp(u + dither_offset(F.col("x"), F.col("y")), 0, 255) if dither else u

    return from_rgb(map_rgb(rgb, lambda r, g, b: (out(r), out(g), out(b)))).select(*FRAME, "ch", "y", "x", F.col("v").alias("u8"))
