"""Generated frames whose truth is known."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def noise(w: int, h: int, seed: int, amplitude: float) -> np.ndarray:
    """Repeatable noise from an integer hash."""
    i = np.arange(w * h, dtype=np.uint64) + np.uint64(seed * 7919)
    k = (i * np.uint64(2654435761) + np.uint64(12345)) % np.uint64(2**32)
    k = (k ^ (k >> np.uint64(15))) * np.uint64(2246822519) % np.uint64(2**32)
    return amplitude * ((k.astype("float64") / 2**32) - 0.5).reshape(h, w)


def star_field(w: int, h: int, stars, seed: int = 1, background: float = 0.05, amplitude: float = 0.004) -> np.ndarray:
    """Gaussian stars (x, y, peak, sigma) on a sloping background."""
    yy, xx = np.mgrid[0:h, 0:w]
    img = background + 0.01 * xx / w + noise(w, h, seed, amplitude)
    for x, y, peak, sigma in stars:
        img = img + peak * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * sigma**2))
    return np.clip(img, 0.0, 1.0)


def frames_of(spark, images: list[tuple[str, int, int, np.ndarray]]):
    """(pixels, frames) from (session, frame_id, frame_number, array[h, w] or [h, w, c])."""
    rows = []
    for session, frame_id, number, img in images:
        h, w = img.shape[:2]
        ch = 1 if img.ndim == 2 else img.shape[2]
        rows.append((session, frame_id, number, w, h, ch, [float(v) for v in img.reshape(-1)]))
    schema = "session string, frame_id bigint, frame_number bigint, width int, height int, channels int, data array<double>"
    df = spark.createDataFrame(rows, schema).repartition(4)
    from pixelweave.operators.pixels import explode_frames

    return explode_frames(df), df.drop("data")


def to_array(df, h: int, w: int, value: str = "v", ch: int = 0, where: str = "true") -> np.ndarray:
    out = np.full((h, w), np.nan)
    for r in df.filter(F.col("ch") == ch).filter(where).select("y", "x", value).collect():
        out[r["y"], r["x"]] = r[value]
    return out
