"""Master frames and calibration: equi-joins on the pixel position.

No broadcast is forced: a master of a large sensor is hundreds of megabytes as rows.
Spark broadcasts it only where the measured size is under its threshold and merges
the two sides on the pixel key otherwise.

A frame with a sample that a master lacks is left out whole and listed; it never loses samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FRAME, PIXEL

FLAT_FLOOR = 0.01


def master_dark(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over frames per pixel. ``keys`` names what identifies a master."""
    keys = PIXEL if keys is None else keys
    return pixels.groupBy(*keys).agg(F.avg("v").alias("dark"))


def master_flat(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean per pixel divided by the mean of the whole master (all channels), floored at 0.01.

    A master whose mean is under 0.01 is rejected: it gives no rows.
    """
    keys = PIXEL if keys is None else keys
    group = [k for k in keys if k not in ("ch", "y", "x")]
    mean = pixels.groupBy(*keys).agg(F.avg("v").alias("_m"))
    flat = F.greatest(F.col("_m") / F.col("_level"), F.lit(FLAT_FLOOR)).alias("flat")
    if not group:  # one master for everything: its level is one number, a scalar subquery
        level = mean.agg(F.avg("_m")).scalar()
        return mean.withColumn("_level", level).filter(F.col("_level") >= FLAT_FLOOR).select(*keys, flat)
    level = mean.groupBy(*group).agg(F.avg("_m").alias("_level")).filter(F.col("_level") >= FLAT_FLOOR)
    return mean.join(level, group).select(*keys, flat)


def _keys_of(master: DataFrame, value: str) -> list[str]:
    return [c for c in master.columns if c != value]


def _applied(pixels: DataFrame, dark: DataFrame | None, flat: DataFrame | None) -> DataFrame:
    """Dark, then flat, on the samples the masters hold. Masters on the same keys are joined first, so the pixels meet
    one join."""
    v = F.col("v")
    if dark is not None and flat is not None and set(_keys_of(dark, "dark")) == set(_keys_of(flat, "flat")):
        keys = _keys_of(dark, "dark")
        j = pixels.join(dark.join(flat, keys), keys)
        return j.withColumn("v", F.greatest(v - F.col("dark"), F.lit(0.0)) / F.col("flat")).select(*pixels.columns)
    out = pixels
    if dark is not None:
        out = out.join(dark, _keys_of(dark, "dark")).withColumn("v", F.greatest(v - F.col("dark"), F.lit(0.0))).select(*pixels.columns)
    if flat is not None:
        out = out.join(flat, _keys_of(flat, "flat")).withColumn("v", v / F.col("flat")).select(*pixels.columns)
    return out


def uncovered(pixels: DataFrame, *masters: DataFrame) -> DataFrame:
    """Frames with samples that some master lacks: frame, missing (samples), reason.

    Masters on the same keys are intersected first, so the pixels are read once for them.
    """
    groups: dict[frozenset, DataFrame] = {}
    for master in masters:
        keys = [c for c in master.columns if c not in ("dark", "flat")]
        held = master.select(*keys)
        known = groups.get(frozenset(keys))
        groups[frozenset(keys)] = held if known is None else known.join(held, keys)
    out = None
    for keys, held in groups.items():
        lost = pixels.join(held, list(keys), "left_anti").select(*FRAME)
        out = lost if out is None else out.unionByName(lost)
    return out.groupBy(*FRAME).agg(F.count("*").alias("missing")).withColumn("reason", F.lit("samples outside a calibration master"))


def calibrate(pixels: DataFrame, dark: DataFrame | None = None, flat: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(calibrated pixels, rejects): dark, then flat; either may be left out.

    ``rejects`` lists the frames that a master does not cover (frame, missing, reason); they have no pixels in the result.
    Without such frames the look-up of them is empty and the plan drops it as it runs.
    """
    masters = [m for m in (dark, flat) if m is not None]
    if not masters:
        return pixels, pixels.select(*FRAME).limit(0).withColumns({"missing": F.lit(0).cast("long"), "reason": F.lit("")})
    rejects = uncovered(pixels, *masters)
    return _applied(pixels.join(rejects.select(*FRAME), FRAME, "left_anti"), dark, flat), rejects


def subtract_dark(pixels: DataFrame, dark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels less the dark, not under zero; rejects)."""
    return calibrate(pixels, dark=dark)


def divide_flat(pixels: DataFrame, flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels over the flat, rejects)."""
    return calibrate(pixels, flat=flat)
