"""Robust statistics per frame and channel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Stats
from ..functions.arrays import sorted_mad, sorted_median
from ..functions.columns import clamp, mad_sigma
from ..model import FRAME
from .pixels import luma_luminance, mean_luminance, strided_sample

CHANNEL = [*FRAME, "ch"]
# samples that one task sorts for medians
TASK_SAMPLES = 1 << 18
# samples up to which a frame is sorted as one array
ARRAY_SAMPLES = 1 << 14


def with_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Add the median of ``value`` per key, each row counted ``weight`` times (0: left out).

    Mean of the middle two for an even count. Windows over sorted rows, which spill; all medians of one
    frame share the exchange on its keys, and nothing is held as one array.
    """
    every = Window.partitionBy(*keys)
    upto = every.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = df.withColumns({"_c": F.sum(weight).over(upto), "_t": F.sum(weight).over(every)})

    def reached(place: Column) -> Column:
        return F.min(F.when((F.col(weight) > 0) & (F.col("_c") >= place), F.col(value))).over(every)

    middle = (reached(F.floor((F.col("_t") + 1) / 2)) + reached(F.floor(F.col("_t") / 2) + 1)) / 2.0
    return counted.withColumn(name, middle).drop("_c", "_t")


def _samples(frames: DataFrame) -> tuple[float, float]:
    """Samples of all frames and of the largest."""
    channels = F.coalesce("channels", F.lit(1)) if "channels" in frames.columns else F.lit(1)
    n = F.col("width").cast("double") * F.col("height") * channels
    total, most = frames.agg(F.sum(n), F.max(n)).first()
    return total or 0, most or 0


def tasks_for(frames: DataFrame, samples: int = TASK_SAMPLES) -> int:
    """Tasks over which the samples of ``frames`` are dealt, so that each has some ``samples`` of them at any input."""
    return max(1, math.ceil(_samples(frames)[0] / samples))


def dealt(pixels: DataFrame, frames: DataFrame, samples: int = TASK_SAMPLES) -> DataFrame:
    """``pixels`` over as many tasks as ``tasks_for``: by frame, or by the rows of frames larger than a task's share.

    What is joined and grouped by frame afterwards stays in these tasks.
    """
    total, most = _samples(frames)
    return pixels.repartition(max(1, math.ceil(total / samples)), *FRAME, *(["y"] if most > samples else []))


def value_counts(df: DataFrame, keys: list[str], value: str, tasks: int | None = None) -> DataFrame:
    """Rows per distinct value (``_n``), merged before the exchange; NULL is left out.

    ``tasks`` deals the groups over as many tasks. The windows of a median hold several sorted copies of a task's
    rows, so their number is not left to the size of the shuffled bytes.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.repartition(tasks, *keys) if tasks else counts


def small(frames: DataFrame) -> bool:
    """Whether each of ``frames`` has at most ARRAY_SAMPLES samples."""
    return _samples(frames)[1] <= ARRAY_SAMPLES


def robust_stats(sample: DataFrame, keys: list[str], value: str = "v", tasks: int | None = None, arrays: bool = False) -> DataFrame:
    """median, mad, sigma = 1.4826*mad, min, max, n per group, from the counts of its distinct values.

    ``arrays``: groups are of frames known to be `small`, and each is sorted as one array.
    """
    if arrays:
        rows = sample.filter(F.col(value).isNotNull()).select(*keys, value)
        rows = rows.repartition(tasks, *keys) if tasks else rows
        g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_a")).withColumn("median", sorted_median(F.col("_a")))
        g = g.withColumn("mad", sorted_mad(F.col("_a"), F.col("median")))
        return g.select(*keys, "median", "mad", mad_sigma(F.col("mad")).alias("sigma"), F.get("_a", F.lit(0)).alias("min"), F.element_at("_a", -1).alias("max"), F.size("_a").cast("long").alias("n"))
    g = with_median(value_counts(sample, keys, value, tasks), keys, value, "_n", "_m")
    g = with_median(g.withColumn("_d", F.abs(F.col(value) - F.col("_m"))), keys, "_d", "_n", "_mad")
    return g.groupBy(*keys).agg(
        F.min("_m").alias("median"),
        F.min("_mad").alias("mad"),
        mad_sigma(F.min("_mad")).alias("sigma"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum("_n").alias("n"),
    )


def image_stats(pixels: DataFrame, frames: DataFrame, config: Stats = Stats()) -> DataFrame:
    """Channel statistics of every sample, or of the strided sample that ``config`` asks for."""
    sample = strided_sample(pixels, frames, config.max_samples, config.min_samples)
    return robust_stats(sample, CHANNEL, tasks=tasks_for(frames), arrays=small(frames))


def luminance_stats(pixels: DataFrame, frames: DataFrame, weighted: bool = True, config: Stats = Stats()) -> DataFrame:
    sampled = strided_sample(pixels, frames, config.max_samples, config.min_samples)
    lum = luma_luminance(sampled) if weighted else mean_luminance(sampled)
    return robust_stats(lum, FRAME, tasks=tasks_for(frames), arrays=small(frames))


def image_summary(stats: DataFrame) -> DataFrame:
    """Means over channels and the low-signal flag."""
    g = stats.groupBy(*FRAME).agg(
        F.avg("median").alias("mean_median"),
        F.avg("sigma").alias("mean_sigma"),
        F.min("min").alias("global_min"),
        F.max("max").alias("global_max"),
        F.count("*").alias("channels"),
    )
    low = (F.col("mean_sigma") > 0) & (F.col("global_max") - F.col("mean_median") < F.col("mean_sigma") * 10.0)
    return g.withColumn("is_low_signal", low)


def black_point(median: Column, sigma: Column, k: float) -> Column:
    return F.greatest(median - k * sigma, F.lit(0.0))


def suggested_levels(stats: DataFrame, k: float = 2.8) -> DataFrame:
    return stats.withColumn("black_point", black_point(F.col("median"), F.col("sigma"), k)).withColumn(
        "signal_range", F.col("max") - F.col("median")
    )


def detection_background(luminance: DataFrame, frames: DataFrame, k: float | Column) -> DataFrame:
    """median, sigma (at least 1e-6) and threshold of a luminance frame."""
    s = robust_stats(strided_sample(luminance, frames), FRAME, tasks=tasks_for(frames), arrays=small(frames))
    sigma = F.greatest(F.col("sigma"), F.lit(1e-6))
    k = k if isinstance(k, Column) else F.lit(float(k))
    return s.select(*FRAME, "median", sigma.alias("sigma"), (F.col("median") + k * sigma).alias("threshold"))


def channel_mode(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Mode per channel from 65 536 bins.

    The first ten bins are skipped, the lowest bin wins a tie, and with nothing left the
    mode is zero.
    """
    s = strided_sample(pixels, frames)
    bins = s.groupBy(*CHANNEL, clamp(F.floor(F.col("v") * 65535.0), 0, 65535).alias("bin")).agg(F.count("*").alias("n"))
    peak = F.max_by(F.col("bin"), F.when(F.col("bin") >= 10, F.struct(F.col("n"), -F.col("bin"))))
    return bins.groupBy(*CHANNEL).agg((F.coalesce(peak, F.lit(0)) / 65535.0).alias("mode"))


MODE_BINS = 4096


def background_samples(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Luminance of every site of the frames."""
    return luma_luminance(strided_sample(pixels, frames))


def background_mode(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    return mode_of_samples(background_samples(pixels, frames))


def mode_of_samples(lum: DataFrame) -> DataFrame:
    """Background mode of luminance samples: 4096 bins, smoothed over five, dark third only.

    Each occupied bin adds its count to the five smoothed bins it reaches, so empty
    stretches of the histogram never become rows.
    """
    top = MODE_BINS - 1
    hist = lum.groupBy(*FRAME, clamp(F.floor(F.col("v") * top), 0, top).cast("int").alias("bin")).agg(
        F.count("*").alias("n")
    )
    spread = hist.select(*FRAME, "n", F.explode(F.sequence(F.col("bin") - 2, F.col("bin") + 2)).alias("bin"))
    first, last = 5, 5 + MODE_BINS * 3 // 10 - 1
    smooth = (
        spread.filter(F.col("bin").between(max(first, 2), min(last, MODE_BINS - 3)))
        .groupBy(*FRAME, "bin")
        .agg(F.floor(F.sum("n") / 5).alias("s"))
    )
    peak = smooth.filter("s > 0").groupBy(*FRAME).agg(F.max_by("bin", F.struct(F.col("s"), -F.col("bin"))).alias("_peak"))
    # without a peak: the bin at which half of the samples are reached
    w = Window.partitionBy(*FRAME).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*FRAME)
    cum = hist.withColumn("_cum", F.sum("n").over(w)).withColumn("_half", F.floor(F.sum("n").over(total) / 2))
    middle = cum.filter("_cum >= _half").groupBy(*FRAME).agg(F.min("bin").alias("_mid"))
    return middle.join(peak, FRAME, "left").select(
        *FRAME, (F.coalesce("_peak", "_mid") / float(top)).alias("mode")
    )


def signal_fraction(samples: DataFrame, levels: DataFrame) -> DataFrame:
    """Share of luminance samples above mode + 2 sigma. ``levels``: frame, mode, sigma."""
    j = samples.join(levels.select(*FRAME, "mode", "sigma"), FRAME)
    over = (F.col("v") > F.col("mode") + 2.0 * F.col("sigma")).cast("double")
    return j.groupBy(*FRAME).agg(F.avg(over).alias("signal_fraction"))


def contrast_std(luminance: DataFrame) -> DataFrame:
    return luminance.groupBy(*FRAME).agg(F.stddev_pop("v").alias("quality"))


def upper_sigma_clip(
    df: DataFrame,
    keys: list[str],
    k: float = 3.0,
    rounds: int = 3,
    value: str = "v",
    keep_flat: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Median after clipping the upper tail at median + k*1.4826*mad, at most ``rounds`` times.

    A round that removes nothing, or a spread under 1e-9, leaves the survivors as they
    are, and later rounds then repeat themselves; so unrolled rounds need no stop flag.
    """
    g = value_counts(df, keys, value, tasks).withColumn("_alive", F.col("_n"))
    for _ in range(rounds):
        g = with_median(g, keys, value, "_alive", "_m")
        g = with_median(g.withColumn("_d", F.abs(F.col(value) - F.col("_m"))), keys, "_d", "_alive", "_mad")
        cut = F.col("_m") + k * mad_sigma(F.col("_mad"))
        limit = F.when(F.col("_mad") < 1e-9, F.lit(float("inf"))).otherwise(cut) if keep_flat else cut
        g = g.withColumn("_alive", F.when(F.col(value) <= limit, F.col("_alive")).otherwise(0))
    g = with_median(g, keys, value, "_alive", "_m")
    return g.groupBy(*keys).agg(F.min("_m").alias("clipped_median"), F.sum("_alive").alias("kept"))
