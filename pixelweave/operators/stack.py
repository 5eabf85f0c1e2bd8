"""Weighted stacking per pixel, quality weights, outlier rejection, verdicts and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Rejection, Weighting
from ..functions import scan
from ..model import FRAME, PIXEL
from .pixels import drop_nan

BORDER_TOLERANCE = 1e-6


def drop_border(pixels: DataFrame, border: float | None = 0.0, tolerance: float = BORDER_TOLERANCE) -> DataFrame:
    """Leave out samples that are not a number, and those equal to the border value (``None``: no such value)."""
    pixels = drop_nan(pixels)
    if border is None:
        return pixels
    return pixels.filter(F.abs(F.col("v") - F.lit(border)) >= tolerance)


def accumulate(pixels: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Mergeable sums per pixel: w, wx, wxx, n. They add up across batches."""
    keys = PIXEL if keys is None else keys
    w = F.col(weight) if weight else F.lit(1.0)
    v = F.col("v")
    return pixels.groupBy(*keys).agg(
        F.sum(w).alias("w"), F.sum(w * v).alias("wx"), F.sum(w * v * v).alias("wxx"), F.count("*").alias("n")
    )


def merge(partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = PIXEL if keys is None else keys
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wxx", "n")])


def finish(sums: DataFrame) -> DataFrame:
    """mean and m2 = sum w (v - mean)^2 from the sums."""
    mean = F.col("wx") / F.col("w")
    m2 = F.greatest(F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w"), F.lit(0.0))
    keys = [c for c in sums.columns if c not in ("w", "wx", "wxx", "n")]
    return sums.select(*keys, "w", mean.alias("mean"), m2.alias("m2"), "n")


def stack(
    pixels: DataFrame,
    weights: DataFrame | None = None,
    keys: list[str] | None = None,
    border: float | None = 0.0,
) -> DataFrame:
    """Weighted mean per pixel. ``weights``: session, frame_id, weight (one row per frame)."""
    kept = drop_border(pixels, border)
    if weights is None:
        return finish(accumulate(kept, keys))
    return finish(accumulate(kept.join(weights.select(*FRAME, "weight"), FRAME), keys, "weight"))


def fill_empty(stacked: DataFrame, grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outer join to the pixel grid: pixels no frame reached have mean 0 and n 0."""
    keys = PIXEL if keys is None else keys
    return grid.select(*keys).join(stacked, keys, "left").select(
        *keys,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("w", "mean", "m2")],
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def coverage(stacked: DataFrame, frame_counts: DataFrame) -> DataFrame:
    """n / frames of the session."""
    counts = frame_counts.select("session", "frames")
    return stacked.join(counts, "session").withColumn("coverage", F.col("n") / F.greatest(F.col("frames"), F.lit(1)))


def _score(value: Column, low: Column, high: Column, inverted: bool) -> Column:
    span = high - low
    norm = (value - low) / span
    return F.when(value.isNull(), 0.5).when(span < 1e-10, 1.0).otherwise(1.0 - norm if inverted else norm)


def quality_weights(
    quality: DataFrame, config: Weighting = Weighting(), final_limits: bool = False, block: int = 4096
) -> DataFrame:
    """Weight per frame from fwhm (lower is better) and snr against the limits seen so far.

    ``quality``: session, frame_id, frame_number, fwhm, snr.  Limits run in frame order,
    in blocks of ``block`` frame numbers so that a long session is not one task.
    ``final_limits`` uses the limits of the whole session instead.
    """
    if config.disabled:
        return quality.withColumn("weight", F.lit(1.0))
    names = ("min_fwhm", "max_fwhm", "min_snr", "max_snr")
    if final_limits:
        limits = quality.groupBy("session").agg(
            F.min("fwhm").alias("min_fwhm"), F.max("fwhm").alias("max_fwhm"), F.min("snr").alias("min_snr"), F.max("snr").alias("max_snr")
        )
        q = quality.join(limits, "session")
    else:
        blocked = scan.number_blocks(quality, "frame_number", block)
        q = scan.running(
            blocked,
            ["session"],
            ["frame_number"],
            {
                "min_fwhm": ("min", F.col("fwhm")),
                "max_fwhm": ("max", F.col("fwhm")),
                "min_snr": ("min", F.col("snr")),
                "max_snr": ("max", F.col("snr")),
            },
        )
        q = scan.unblocked(q)
    return q.withColumn("weight", weight_expr(config)).drop(*names)


def weight_expr(config: Weighting) -> Column:
    """Weight from fwhm, snr and the four limit columns."""
    combined = F.lit(config.fwhm_weight) * _score(
        F.col("fwhm"), F.col("min_fwhm"), F.col("max_fwhm"), True
    ) + F.lit(config.snr_weight) * _score(F.col("snr"), F.col("min_snr"), F.col("max_snr"), False)
    return F.greatest(F.pow(combined, F.lit(config.power)), F.lit(config.min_weight))


# ---- rejection ---------------------------------------------------------------

RejectFn = Callable[[DataFrame, list[str]], DataFrame]


def _weighted(pixels: DataFrame) -> DataFrame:
    return pixels if "weight" in pixels.columns else pixels.withColumn("weight", F.lit(1.0))


def sigma_clip(pixels: DataFrame, keys: list[str], config: Rejection = Rejection("sigma_clip")) -> DataFrame:
    """Surviving samples after up to ``max_iterations`` rounds of clipping about the mean.

    Every round is a window over the same pixel key, so all rounds share one exchange.
    Pixels with fewer than ``min_frames`` samples are left alone.
    """
    alive = _weighted(pixels)
    w = Window.partitionBy(*keys)
    for _ in range(config.max_iterations):
        t = alive.withColumn("_m", F.avg("v").over(w)).withColumn("_s", F.stddev_pop("v").over(w)).withColumn("_n", F.count("*").over(w))
        inside = F.col("v").between(
            F.col("_m") - config.sigma_low * F.col("_s") - 1e-12, F.col("_m") + config.sigma_high * F.col("_s") + 1e-12
        )
        alive = t.filter((F.col("_n") < config.min_frames) | inside).drop("_m", "_s", "_n")
    return alive


def winsorize(pixels: DataFrame, keys: list[str], config: Rejection = Rejection("winsorized")) -> DataFrame:
    """As ``sigma_clip``, but outliers are pulled to the limit instead of dropped."""
    out = _weighted(pixels)
    w = Window.partitionBy(*keys)
    for _ in range(config.max_iterations):
        t = out.withColumn("_m", F.avg("v").over(w)).withColumn("_s", F.stddev_pop("v").over(w)).withColumn("_n", F.count("*").over(w))
        low, high = F.col("_m") - config.sigma_low * F.col("_s"), F.col("_m") + config.sigma_high * F.col("_s")
        pulled = F.when(F.col("_n") < config.min_frames, F.col("v")).otherwise(F.least(F.greatest("v", low), high))
        out = t.withColumn("v", pulled).drop("_m", "_s", "_n")
    return out


def drop_extremes(pixels: DataFrame, keys: list[str], config: Rejection = Rejection("min_max")) -> DataFrame:
    """Drop one smallest and one largest sample where at least three exist.

    Which of equal samples goes does not change the mean; ``frame_id`` breaks the tie.
    """
    up = Window.partitionBy(*keys).orderBy("v", "frame_id")
    n = F.count("*").over(Window.partitionBy(*keys))
    t = _weighted(pixels).withColumn("_r", F.row_number().over(up)).withColumn("_n", n)
    keep = (F.col("_n") < max(config.min_frames, 3)) | ((F.col("_r") > 1) & (F.col("_r") < F.col("_n")))
    return t.filter(keep).drop("_r", "_n")


METHODS: dict[str, Callable[[DataFrame, list[str], Rejection], DataFrame]] = {
    "sigma_clip": sigma_clip,
    "winsorized": winsorize,
    "min_max": drop_extremes,
}


def reject(pixels: DataFrame, keys: list[str] | None = None, config: Rejection = Rejection(), custom: RejectFn | None = None) -> DataFrame:
    """Apply the configured rejection, or a caller's ``custom(pixels, keys)``."""
    keys = PIXEL if keys is None else keys
    if custom is not None:
        return custom(pixels, keys)
    if config.method == "none":
        return pixels
    return METHODS[config.method](pixels, keys, config)


def rejected_stack(
    pixels: DataFrame,
    config: Rejection,
    weights: DataFrame | None = None,
    keys: list[str] | None = None,
    border: float | None = 0.0,
    custom: RejectFn | None = None,
) -> DataFrame:
    """Border, weights, rejection, then the weighted mean of what is left."""
    kept = drop_border(pixels, border)
    kept = kept.join(weights.select(*FRAME, "weight"), FRAME) if weights is not None else _weighted(kept)
    return finish(accumulate(reject(kept, keys, config, custom), keys, "weight"))


def min_max_mean(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(sum - min - max)/(n - 2) for n >= 3, without ordering the samples."""
    keys = PIXEL if keys is None else keys
    g = pixels.groupBy(*keys).agg(
        F.sum("v").alias("_s"), F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("*").alias("n")
    )
    mean = F.when(F.col("n") >= 3, (F.col("_s") - F.col("_lo") - F.col("_hi")) / (F.col("n") - 2)).otherwise(F.col("_s") / F.col("n"))
    return g.select(*keys, mean.alias("mean"), "n")


# ---- verdicts and session statistics ----------------------------------------


def verdicts(frames: DataFrame, checked: DataFrame, star_counts: DataFrame, registration: DataFrame, min_stars: int = 3) -> DataFrame:
    """One row per frame: dimension mismatch, too few stars, registration failed or stacked.

    ``checked``: frame, accepted, reason.  ``star_counts``: frame, stars.
    ``registration``: frame, status, reason, residual (``status`` is ``ok`` or ``failed``).
    The reference frame of a session has status ``reference``.
    """
    j = (
        frames.select(*FRAME, "frame_number")
        .join(checked.select(*FRAME, "accepted", F.col("reason").alias("_dim")), FRAME, "left")
        .join(star_counts.select(*FRAME, "stars"), FRAME, "left")
        .join(registration.select(*FRAME, "status", F.col("reason").alias("_reg"), "residual"), FRAME, "left")
    )
    stars = F.coalesce("stars", F.lit(0))
    verdict = (
        F.when(~F.coalesce("accepted", F.lit(False)), "rejected_dimensions")
        .when(stars < min_stars, "rejected_stars")
        .when(F.coalesce("status", F.lit("failed")) == "failed", "rejected_registration")
        .otherwise("stacked")
    )
    few = F.format_string("%d stars found, %d wanted", stars, F.lit(min_stars))
    reason = (
        F.when(F.col("verdict") == "rejected_dimensions", F.col("_dim"))
        .when(F.col("verdict") == "rejected_stars", few)
        .when(F.col("verdict") == "rejected_registration", F.concat(F.lit("not registered: "), F.coalesce("_reg", F.lit("no result"))))
    )
    return (
        j.withColumn("verdict", verdict)
        .withColumn("reason", reason)
        .select(
            *FRAME,
            "frame_number",
            F.when(F.col("verdict") == "rejected_dimensions", 0).otherwise(stars).alias("stars"),
            F.when((F.col("verdict") == "stacked") & (F.col("status") == "ok"), F.col("residual")).alias("residual"),
            "verdict",
            "reason",
        )
    )


def stacking_stats(verdict: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by cause, average stars, average residual and success rate (percent).

    With two or more ``by`` columns the report also holds the rolled-up levels.
    """
    by = ["session"] if by is None else by

    def count(name: str) -> Column:
        return F.sum((F.col("verdict") == name).cast("long")).alias("frames_stacked" if name == "stacked" else name)

    grouped = verdict.groupBy(*by) if len(by) == 1 else verdict.rollup(*by)
    out = grouped.agg(
        F.count("*").alias("frames_received"),
        count("stacked"),
        count("rejected_stars"),
        count("rejected_registration"),
        count("rejected_dimensions"),
        (F.sum("stars") / F.count("*")).alias("avg_stars"),
        F.coalesce(F.avg("residual"), F.lit(0.0)).alias("avg_residual"),
        *([] if len(by) == 1 else [F.grouping_id().alias("level")]),
    )
    return out.withColumn("success_rate", 100.0 * F.col("frames_stacked") / F.col("frames_received"))


def segments(log: DataFrame, wanderer: bool = False, block: int = 4096) -> DataFrame:
    """Number the stacks of a session.

    ``log``: session, frame_number, stacking BOOLEAN, stacking_type, width, height,
    registered BOOLEAN.  A new stack starts when stacking is switched on or changes type,
    when the frame size changes, and in wanderer mode after a frame that failed to register.
    """
    blocked = scan.number_blocks(log, "frame_number", block)
    prev = scan.previous(
        blocked,
        ["session"],
        ["frame_number"],
        {
            "_s": F.col("stacking"),
            "_t": F.col("stacking_type"),
            "_w": F.col("width"),
            "_h": F.col("height"),
            "_r": F.col("registered"),
        },
    )
    on = F.col("stacking") & (~F.coalesce("_s", F.lit(False)) | (F.col("stacking_type") != F.col("_t")))
    size = (F.col("width") != F.col("_w")) | (F.col("height") != F.col("_h"))
    change = F.coalesce(on, F.lit(False)) | F.coalesce(size, F.lit(False))
    if wanderer:
        change = change | F.coalesce(F.col("_s") & ~F.col("_r"), F.lit(False))
    flagged = prev.withColumn("_new", change.cast("long"))
    out = scan.running(flagged, ["session"], ["frame_number"], {"segment": ("sum", F.col("_new"))})
    return out.drop("_s", "_t", "_w", "_h", "_r", "_new", scan.BLOCK)
