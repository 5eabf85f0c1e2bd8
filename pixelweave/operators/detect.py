"""Star detection on luminance pixels."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import DETECTION, Detection
from ..functions.columns import mad_sigma, upper_median
from ..model import FRAME, SITE
from ..session import settle
from . import stats as S
from .pixels import strided_sample


def local_maxima(luminance: DataFrame, frames: DataFrame, levels: DataFrame, config: Detection) -> DataFrame:
    """Sites at or over the threshold that no neighbour within ``search_radius`` beats.

    Of equal values the later one in scan order wins.  Only a site over the threshold can
    beat a candidate, so bright sites (a few per cent) send v to the sites they could
    beat; a site is a maximum when its own is over what later sites send, and not under what earlier ones do.
    """
    r = config.search_radius
    bright = (
        luminance.join(levels.select(*FRAME, "threshold"), FRAME).filter(F.col("v") >= F.col("threshold")).select(*SITE, "v")
    )
    reach, dy, dx = F.sequence(F.lit(-r), F.lit(r)), F.col("_dy"), F.col("_dx")
    sent = bright.withColumn("_dy", F.explode(reach)).withColumn("_dx", F.explode(reach))
    own, later = (dy == 0) & (dx == 0), (dy < 0) | ((dy == 0) & (dx < 0))
    # numbers only, so the sums merge by hashing and nothing is sorted
    top = sent.groupBy(*FRAME, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")).agg(
        F.max(F.when(own, F.col("v"))).alias("value"), F.max(F.when(later, F.col("v"))).alias("_later"), F.max(F.when(~own & ~later, F.col("v"))).alias("_earlier")
    )
    unbeaten = F.coalesce(F.col("value") > F.col("_later"), F.lit(True)) & F.coalesce(F.col("value") >= F.col("_earlier"), F.lit(True))
    own_top = top.filter(F.col("value").isNotNull() & unbeaten)
    m = config.border_margin
    dims = frames.select(*FRAME, "width", "height")
    inside = (F.col("y") >= m) & (F.col("x") >= m) & (F.col("y") < F.col("height") - m) & (F.col("x") < F.col("width") - m)
    return own_top.select(*SITE, "value").join(dims, FRAME).filter(inside).select(*SITE, "value")


@F.pandas_udf(T.DoubleType())
def half_max_width(side: pd.Series, window: pd.Series, sky: pd.Series, peak: pd.Series) -> pd.Series:
    """FWHM from the connected area over half maximum around the peak of each window.

    A window is (2R+1)^2 samples, NaN outside the frame; all windows of a batch grow together.  NULL when the
    area reaches the window edge or the frame edge.
    """
    n, s = len(side), int(side.iloc[0]) if len(side) else 1
    if n == 0:
        return pd.Series([], dtype="float64")
    box = np.stack(window.to_list()).astype("float64").reshape(n, s, s)
    level = ((peak - sky) * 0.5).to_numpy("float64")
    base = sky.to_numpy("float64")
    outside = np.isnan(box)
    bright = ~outside & (np.nan_to_num(box) - base[:, None, None] >= level[:, None, None])
    region = np.zeros_like(bright)
    c = s // 2
    region[:, c, c] = bright[:, c, c]

    def sides(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        out[:, 1:] |= a[:, :-1]
        out[:, :-1] |= a[:, 1:]
        out[:, :, 1:] |= a[:, :, :-1]
        out[:, :, :-1] |= a[:, :, 1:]
        return out

    while True:
        inner = region.copy()
        inner[:, [0, -1], :] = False
        inner[:, :, [0, -1]] = False
        grown = region | (sides(inner) & bright)
        if (grown == region).all():
            break
        region = grown
    edge = region[:, [0, -1], :].any(axis=(1, 2)) | region[:, :, [0, -1]].any(axis=(1, 2))
    edge |= (sides(region) & outside).any(axis=(1, 2))
    area = region.sum(axis=(1, 2))
    ok = ~edge & (area > 0) & (level > 0) & ~np.isnan(base)
    return pd.Series(np.where(ok, 2.0 * np.sqrt(area / np.pi), np.nan)).where(ok, None)


def _windows(schema: T.StructType, r: int):
    """Sums over the window (2R+1)^2 and the square ring at 2R of the candidates of one band, from its samples."""
    arrow = to_arrow_schema(schema)
    dy, dx = (a.ravel() for a in np.mgrid[-2 * r : 2 * r + 1, -2 * r : 2 * r + 1])
    in_window, on_ring = np.maximum(abs(dy), abs(dx)) <= r, np.maximum(abs(dy), abs(dx)) == 2 * r
    slots = np.concatenate([np.flatnonzero(in_window), np.flatnonzero(on_ring)])
    dy, dx, side = dy[slots], dx[slots], int(in_window.sum())

    def run(samples: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not samples.num_rows:
            return arrow.empty_table()
        y, x, v = (samples[c].to_numpy().astype(t) for c, t in (("y", "int64"), ("x", "int64"), ("v", "float64")))
        py, px = (found[c].to_numpy().astype("int64")[:, None] for c in ("peak_y", "peak_x"))
        median, threshold = (found[c].to_numpy()[:, None] for c in ("median", "threshold"))
        low, wide = x.min(), x.max() - x.min() + 1
        key = y * wide + x - low
        order = np.argsort(key, kind="stable")
        key = key[order]
        tx, wanted = px + dx, (py + dy) * wide + px + dx - low
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        here = (key[at] == wanted) & (tx >= low) & (tx < low + wide)
        v = np.where(here, v[order][at], np.nan)
        win, ring, here_win = v[:, :side], np.sort(v[:, side:], axis=1), here[:, :side]
        net = np.where(here_win, np.maximum(win - median, 0.0), 0.0)
        lit = here_win & ~(net <= 0)  # as in SQL, NaN is over every number
        peak = np.where(lit, win, -np.inf).max(axis=1)
        n = here[:, side:].sum(axis=1)
        sky = pa.array(ring[np.arange(len(n)), n // 2], mask=n == 0)
        out = {
            "flux": net.sum(axis=1),
            "_sx": (tx[:, :side] * net).sum(axis=1),
            "_sy": ((py + dy)[:, :side] * net).sum(axis=1),
            "peak": np.where(lit.any(axis=1), peak, 0.0),
            "bright_pixels": (lit & ~(win <= threshold * 0.5)).sum(axis=1),
            "local_sky": sky,
            "_win": pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype="int32") * side, win.ravel()),
        }
        return pa.table([out[f.name] if f.name in out else found[f.name] for f in arrow], schema=arrow)

    return run


# rows of a frame that are measured together, with 2R more on each side
BAND = 64


def measure(luminance: DataFrame, levels: DataFrame, candidates: DataFrame, config: Detection) -> DataFrame:
    """Centroid, flux, peak, snr, local sky and FWHM of each candidate, with ``reject_reason``.

    The samples of a band of a frame's rows meet its candidates in one group; rows near the edge of a band go to both.
    """
    r = config.centroid_radius
    band = lambda y: F.floor(y / BAND).cast("int")
    c = candidates.select(*FRAME, F.col("y").alias("peak_y"), F.col("x").alias("peak_x"), F.col("value"))
    c = c.join(levels.select(*FRAME, "median", "sigma", "threshold"), FRAME).withColumn("_band", band(F.col("peak_y")))
    bands = F.sequence(band(F.col("y") - 2 * r), band(F.col("y") + 2 * r))
    samples = luminance.filter("v IS NOT NULL").select(*SITE, F.col("v").cast("double").alias("v")).withColumn("_band", F.explode(bands)).filter("_band >= 0")
    keys = [*FRAME, "peak_y", "peak_x"]
    double = ["flux", "_sx", "_sy", "peak", "local_sky"]
    schema = T.StructType([c.schema[k] for k in [*keys, "value", "median", "sigma"]])
    for name in double:
        schema = schema.add(name, T.DoubleType())
    schema = schema.add("bright_pixels", T.LongType()).add("_win", T.ArrayType(T.DoubleType()))
    together = [*FRAME, "_band"]
    c = c.toDF(*c.columns)  # both sides may come of the same pixels
    g = samples.groupBy(*together).cogroup(c.groupBy(*together)).applyInArrow(_windows(schema, r), schema)
    noise = F.col("sigma") * float(2 * r + 1)
    g = g.select(
        *keys,
        "value",
        "flux",
        "peak",
        "bright_pixels",
        "_win",
        F.greatest(F.col("peak") - F.col("median"), F.lit(0.0)).alias("_net_peak"),
        (F.col("_sx") / F.col("flux")).alias("x"),
        (F.col("_sy") / F.col("flux")).alias("y"),
        F.when(noise > 1e-10, F.col("flux") / noise).otherwise(F.sqrt("flux")).alias("snr"),
        "local_sky",
    )
    away = F.sqrt(F.pow(F.col("x") - F.col("peak_x"), 2) + F.pow(F.col("y") - F.col("peak_y"), 2))
    reason = (
        F.when(F.col("flux") < 1e-6, "no flux")
        .when(F.col("_net_peak") / F.col("flux") > config.hot_pixel_threshold, "hot pixel")
        .when(F.col("bright_pixels") < config.min_star_pixels, "too few pixels")
        .when(away > float(r), "centroid far from peak")
        .when(F.col("snr") < config.min_snr, "low snr")
    )
    return g.withColumn("reject_reason", reason).drop("_net_peak")


def with_fwhm(measured: DataFrame, config: Detection) -> DataFrame:
    width = half_max_width(
        F.lit(2 * config.centroid_radius + 1),
        F.col("_win"),
        F.col("local_sky"),
        F.col("value"),
    )
    return measured.withColumn("fwhm", width)


def brightest(stars: DataFrame, n: int | None) -> DataFrame:
    """Number the stars of a frame by falling flux and keep the first ``n``.

    Ranks over a limit are cut before the exchange as well as after it.
    """
    w = Window.partitionBy(*FRAME).orderBy(F.col("flux").desc(), "peak_y", "peak_x")
    ranked = stars.withColumn("star_idx", F.row_number().over(w) - 1)
    return ranked if n is None else ranked.filter(F.col("star_idx") < n)


STAR = [*FRAME, "star_idx", "x", "y", "flux", "peak", "snr", "fwhm"]


def detect(luminance: DataFrame, frames: DataFrame, config: Detection = Detection(), fwhm: bool = True) -> DataFrame:
    """Stars of every frame: star_idx (0 = brightest), x, y, flux, peak, snr, fwhm."""
    levels = S.detection_background(luminance, frames, config.sigma_threshold)
    candidates = local_maxima(luminance, frames, levels, config)
    kept = brightest(measure(luminance, levels, candidates, config).filter("reject_reason IS NULL"), config.max_stars)
    kept = with_fwhm(kept, config) if fwhm else kept.withColumn("fwhm", F.lit(None).cast("double"))
    return kept.select(*STAR)


def frame_medians(stars: DataFrame) -> DataFrame:
    """Median FWHM (unknown ones ignored) and SNR per frame, and the star count."""
    return stars.groupBy(*FRAME).agg(
        F.median("fwhm").alias("fwhm"), F.median("snr").alias("snr"), F.count("*").alias("stars")
    )


def _cascade(luminance: DataFrame, frames: DataFrame, steps: list[tuple[str, Detection, int]]) -> DataFrame:
    """Run presets in turn, each only on the frames the ones before did not settle.

    The last step keeps whatever it finds.  Accepted stars are written out per step, so a
    later step does not repeat an earlier one.
    """
    todo, out = frames, None
    for i, (name, config, needed) in enumerate(steps):
        lum = luminance if out is None else luminance.join(todo.select(*FRAME), FRAME, "left_semi")
        found = detect(lum, todo, config).withColumn("config", F.lit(name))
        if i == len(steps) - 1:
            return found if out is None else out.unionByName(found)
        found = settle(found)
        enough = found.groupBy(*FRAME).agg(F.count("*").alias("_n")).filter(F.col("_n") >= needed).select(*FRAME)
        good = found.join(enough, FRAME, "left_semi")
        out = good if out is None else out.unionByName(good)
        todo = todo.join(enough, FRAME, "left_anti")
    return out


def detect_adaptive(luminance: DataFrame, frames: DataFrame) -> DataFrame:
    """fast (10 stars settle a frame), then sensitive (3), then aggressive; every star is kept."""
    return _cascade(
        luminance,
        frames,
        [
            ("fast", DETECTION["fast"], 10),
            ("sensitive", DETECTION["sensitive"], 3),
            ("aggressive", DETECTION["aggressive"], 0),
        ],
    )


def analyse(luminance: DataFrame, frames: DataFrame) -> DataFrame:
    """Median (upper), sigma, brightest value, dynamic range and the preset they suggest."""
    sample = strided_sample(luminance, frames)
    med = sample.groupBy(*FRAME).agg(upper_median("v").alias("median"))
    dev = sample.join(med, FRAME).withColumn("_d", F.abs(F.col("v") - F.col("median")))
    mad = dev.groupBy(*FRAME).agg(upper_median("_d").alias("_mad"))
    top = luminance.groupBy(*FRAME).agg(F.max("v").alias("max_value"))
    a = med.join(mad, FRAME).join(top, FRAME)
    span = F.col("max_value") / F.greatest(F.col("median"), F.lit(1e-6))
    a = a.withColumn("sigma", F.greatest(mad_sigma(F.col("_mad")), F.lit(1e-6))).withColumn("dynamic_range", span)
    preset = F.when(F.col("median") < 0.05, "sensitive").when(F.col("dynamic_range") > 50.0, "default").otherwise("medium")
    return a.select(*FRAME, "median", "sigma", "max_value", "dynamic_range", preset.alias("preset"))


def detect_thorough(luminance: DataFrame, frames: DataFrame) -> DataFrame:
    """The preset suggested by the image, then default at 3 sigma, sensitive, aggressive; 3 stars settle a frame."""
    picked = settle(analyse(luminance, frames).select(*FRAME, "preset"))
    first = {
        "sensitive": DETECTION["sensitive"],
        "default": DETECTION["default"],
        "medium": replace(DETECTION["default"], sigma_threshold=4.0, min_snr=3.0),
    }
    parts = []
    for name, config in first.items():
        mine = picked.filter(F.col("preset") == name).select(*FRAME)
        part = detect(luminance.join(mine, FRAME, "left_semi"), frames.join(mine, FRAME, "left_semi"), config)
        parts.append(part.withColumn("config", F.lit(name)))
    found = settle(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    enough = found.groupBy(*FRAME).agg(F.count("*").alias("_n")).filter("_n >= 3").select(*FRAME)
    rest = frames.join(enough, FRAME, "left_anti")
    lum = luminance.join(rest.select(*FRAME), FRAME, "left_semi")
    more = _cascade(
        lum,
        rest,
        [
            ("default_3", replace(DETECTION["default"], sigma_threshold=3.0, min_snr=3.0), 3),
            ("sensitive", DETECTION["sensitive"], 3),
            ("aggressive", DETECTION["aggressive"], 0),
        ],
    )
    return found.join(enough, FRAME, "left_semi").unionByName(more)
