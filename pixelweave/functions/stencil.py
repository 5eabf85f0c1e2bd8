"""Neighbourhoods of pixels by two window passes.

Frames are brought together once (one exchange on the frame key); the pass along x
and the pass along y then only sort.  A frame is bounded by its sensor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FRAME


def name(dy: int, dx: int) -> str:
    def part(v: int) -> str:
        return f"m{-v}" if v < 0 else f"p{v}" if v > 0 else "0"

    return f"n_{part(dy)}_{part(dx)}"


def at(dy: int, dx: int) -> Column:
    return F.col(name(dy, dx))


def neighbourhood(pixels: DataFrame, radius: int, clamped: bool, value: str = "v", extra: Sequence[str] = ()) -> DataFrame:
    """Add columns ``n_<dy>_<dx>`` with the value at each offset.

    ``clamped`` repeats the edge value outside the frame; otherwise those are NULL.
    """
    keys = [*FRAME, *(c for c in ("ch",) if c in pixels.columns), *extra]
    together = pixels.repartition(*[F.col(k) for k in FRAME])
    along_x = Window.partitionBy(*keys, "y").orderBy("x")
    along_y = Window.partitionBy(*keys, "x").orderBy("y")

    def shifted(col: Column, step: int, window) -> Column:
        return F.lag(col, -step).over(window) if step < 0 else F.lead(col, step).over(window)

    def reach(col: Column, step: int, window) -> Column:
        if step == 0:
            return col
        sign = 1 if step > 0 else -1
        options = [shifted(col, sign * k, window) for k in range(abs(step), 0, -1)]
        return F.coalesce(*options, col) if clamped else options[0]

    offsets = range(-radius, radius + 1)
    row = together.withColumn("_row", F.struct(*[reach(F.col(value), dx, along_x).alias(f"c{dx + radius}") for dx in offsets]))
    rows = row.select("*", *[reach(F.col("_row"), dy, along_y).alias(f"_r{dy + radius}") for dy in offsets])
    return rows.select(
        *pixels.columns,
        *[F.col(f"_r{dy + radius}.c{dx + radius}").alias(name(dy, dx)) for dy in offsets for dx in offsets],
    )
