"""Resampling: every source pixel adds its share to the target pixels it reaches.

Bilinear sampling at s gives source x the weight 1 - |s - x|.  Sending shares from
source to target needs no join with a target grid; shares of one target mostly start
in the same task, so the partial aggregation merges them before the one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as TL
from ..functions.geometry import forward, inverse
from ..model import FRAME, FRAME_PIXEL


def _spread(j: DataFrame, cx: Column, cy: Column, reach_low: int, reach_high: int) -> DataFrame:
    steps = F.sequence(F.lit(-reach_low), F.lit(reach_high))
    t = j.withColumn("_cx", F.floor(cx).cast("int")).withColumn("_cy", F.floor(cy).cast("int"))
    t = t.withColumn("_ty", F.explode(F.transform(steps, lambda d: F.col("_cy") + d)))
    return t.withColumn("_tx", F.explode(F.transform(steps, lambda d: F.col("_cx") + d)))


def _gather(t: DataFrame, sx: Column, sy: Column, valid: Column) -> DataFrame:
    t = t.withColumn("_sx", sx).withColumn("_sy", sy)
    wx, wy = 1.0 - F.abs(F.col("_sx") - F.col("x")), 1.0 - F.abs(F.col("_sy") - F.col("y"))
    inside = (F.col("_tx") >= 0) & (F.col("_ty") >= 0) & (F.col("_tx") < F.col("width")) & (F.col("_ty") < F.col("height"))
    return (
        t.withColumn("_wx", wx)
        .withColumn("_wy", wy)
        .filter(inside & valid & (F.col("_wx") > 0) & (F.col("_wy") > 0))
        .groupBy(*FRAME, "ch", F.col("_ty").alias("y"), F.col("_tx").alias("x"))
        .agg(F.sum(F.col("_wx") * F.col("_wy") * F.col("v")).alias("v"))
    )


def warp(pixels: DataFrame, transforms: DataFrame, frames: DataFrame, max_scale: float = 1.10) -> DataFrame:
    """Frames in reference coordinates; target pixels without a source are left out.

    A target takes its value at the inverse-mapped point (sx, sy), valid for
    0 <= sx < w-2 and 0 <= sy < h-2.  ``complete_grid`` fills the rest with a border.
    """
    t = transforms.select(*FRAME, "rotation", "scale", "tx", "ty").join(frames.select(*FRAME, "width", "height"), FRAME)
    j = pixels.join(t, FRAME)
    # a square of half-width 1 around the source maps into one of half-width scale*sqrt(2)
    reach = math.ceil(max_scale * math.sqrt(2.0))
    cx, cy = forward(F.col("x"), F.col("y"))
    s = _spread(j, cx, cy, reach, reach + 1)
    sx, sy = inverse(F.col("_tx"), F.col("_ty"))
    valid = (F.col("_sx") >= 0) & (F.col("_sx") < F.col("width") - 2) & (F.col("_sy") >= 0) & (F.col("_sy") < F.col("height") - 2)
    return _gather(s, sx, sy, valid).select(*FRAME_PIXEL, "v")


def translate(pixels: DataFrame, offsets: DataFrame, frames: DataFrame) -> DataFrame:
    """Move frames by (dx, dy), bilinear; valid for 0 <= sx < w-1 and 0 <= sy < h-1.

    Offsets under 0.001 in both directions leave the frame as it is.
    """
    dims = frames.select(*FRAME, "width", "height")
    j = pixels.join(offsets.select(*FRAME, "dx", "dy").join(dims, FRAME), FRAME)
    still = (F.abs("dx") < 0.001) & (F.abs("dy") < 0.001)
    s = _spread(j.filter(~still), F.col("x") + F.col("dx"), F.col("y") + F.col("dy"), 0, 1)
    sx, sy = F.col("_tx") - F.col("dx"), F.col("_ty") - F.col("dy")
    valid = (F.col("_sx") >= 0) & (F.col("_sx") < F.col("width") - 1) & (F.col("_sy") >= 0) & (F.col("_sy") < F.col("height") - 1)
    moved = _gather(s, sx, sy, valid).select(*FRAME_PIXEL, "v")
    return moved.unionByName(j.filter(still).select(*FRAME_PIXEL, "v"))


# ---- tiles -------------------------------------------------------------------------


def _back(r: dict, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sy, sx) of target points."""
    c, n = math.cos(r["rotation"]), math.sin(r["rotation"])
    u, v = x - r["tx_"], y - r["ty_"]
    return (c * v - n * u) / r["scale"], (c * u + n * v) / r["scale"]


def _box(ys: np.ndarray, xs: np.ndarray) -> tuple[int, int, int, int]:
    return math.floor(ys.min()), math.floor(xs.min()), math.floor(ys.max()) + 2, math.floor(xs.max()) + 2


def _corners(y0: float, x0: float, y1: float, x1: float) -> tuple[np.ndarray, np.ndarray]:
    return np.array([y0, y0, y1, y1], float), np.array([x0, x1, x0, x1], float)


def resample_tiles(tiles: DataFrame, transforms: DataFrame, margin: int, side: int = TL.SIDE) -> DataFrame:
    """Tiles of the frames in reference coordinates, by bilinear samples at the inverse-mapped points.

    A tile sends each target tile it reaches the rectangle that one samples from; a target tile puts the
    rectangles together. Points are valid for 0 <= sx < w - margin, 0 <= sy < h - margin; samples that are not there
    add nothing, and a target without any is NaN. Frames of identity transforms keep their samples where
    ``still`` is true. ``transforms``: frame, rotation, scale, tx, ty, still.
    """
    moved = transforms.select(*FRAME, "rotation", "scale", F.col("tx").alias("tx_"), F.col("ty").alias("ty_"), "still")
    moved = moved.select(*FRAME, *[F.col(c).cast("double") for c in ("rotation", "scale", "tx_", "ty_")], "still")
    known = tiles.join(moved, FRAME)
    known = known.select(*[c for c in known.columns if c != "data"], "data")

    def source_of(r: dict, ty: int, tx: int) -> tuple[int, int, int, int]:
        """The rectangle of the source that target tile (ty, tx) samples from."""
        h, w = TL.size_of({**r, "ty": ty, "tx": tx}, side)
        return _box(*_back(r, *_corners(ty * side, tx * side, ty * side + h - 1, tx * side + w - 1)))

    def need(r: dict) -> Iterator[tuple]:
        h, w = TL.size_of(r, side)
        if r["still"]:
            yield r["ty"], r["tx"], (r["ty"] * side, r["tx"] * side, r["ty"] * side + h, r["tx"] * side + w)
            return
        # where the tile, one sample wider, lands
        ys, xs = _corners(r["ty"] * side - 1, r["tx"] * side - 1, r["ty"] * side + h, r["tx"] * side + w)
        c, n = math.cos(r["rotation"]), math.sin(r["rotation"])
        y0, x0, y1, x1 = _box(r["scale"] * (n * xs + c * ys) + r["ty_"], r["scale"] * (c * xs - n * ys) + r["tx_"])
        for ty in range(max(0, y0 // side), min(r["fh"] - 1, y1) // side + 1):
            for tx in range(max(0, x0 // side), min(r["fw"] - 1, x1) // side + 1):
                yield ty, tx, source_of(r, ty, tx)

    def kernel(r: dict, parts: list) -> Iterator[tuple]:
        h, w = TL.size_of(r, side)
        y0, x0 = r["ty"] * side, r["tx"] * side
        if r["still"]:
            out = TL.canvas(parts, y0, x0, y0 + h, x0 + w)
        else:
            a, b, c, d = source_of(r, r["ty"], r["tx"])
            source = TL.canvas(parts, a, b, c + 1, d + 1)
            there = ~np.isnan(source)
            source = np.where(there, source, 0.0)
            y, x = (g.astype(float) for g in np.mgrid[y0 : y0 + h, x0 : x0 + w])
            sy, sx = _back(r, y, x)
            py, px = np.floor(sy).astype(int), np.floor(sx).astype(int)
            total, found = np.zeros((h, w)), np.zeros((h, w), bool)
            for dy in (0, 1):
                for dx in (0, 1):
                    wy, wx = 1.0 - np.abs(sy - (py + dy)), 1.0 - np.abs(sx - (px + dx))
                    at = np.clip(py + dy - a, 0, c - a), np.clip(px + dx - b, 0, d - b)
                    use = there[at] & (wy > 0) & (wx > 0)
                    total += np.where(use, wx * wy * source[at], 0.0)
                    found |= use
            valid = (sx >= 0) & (sx < r["fw"] - margin) & (sy >= 0) & (sy < r["fh"] - margin)
            out = np.where(found & valid, total, np.nan)
        if not np.isnan(out).all():
            yield *[r[k] for k in TL.KEY], h, w, r["fh"], r["fw"], out.tobytes()

    return TL.exchanged(known, need, kernel, TL.tile_schema(tiles), side)


def warp_tiles(tiles: DataFrame, transforms: DataFrame, side: int = TL.SIDE) -> DataFrame:
    """`warp` on tiles, at any scale."""
    return resample_tiles(tiles, transforms.withColumn("still", F.lit(False)), 2, side)


def translate_tiles(tiles: DataFrame, offsets: DataFrame, side: int = TL.SIDE) -> DataFrame:
    """`translate` on tiles."""
    still = (F.abs("dx") < 0.001) & (F.abs("dy") < 0.001)
    t = offsets.select(*FRAME, F.lit(0.0).alias("rotation"), F.lit(1.0).alias("scale"), F.col("dx").alias("tx"), F.col("dy").alias("ty"), still.alias("still"))
    return resample_tiles(tiles, t, 1, side)
