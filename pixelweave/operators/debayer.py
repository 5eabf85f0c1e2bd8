"""Colour filter mosaics to three channels: pattern detection, bilinear and gradient-based."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CFA_PATTERNS
from ..functions import tiles as TL
from ..functions.columns import cfa_colour, clamp
from ..functions.stencil import at, neighbourhood
from ..model import FRAME


def detect_pattern(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Pattern and confidence per mono frame from the means of the four grid positions.

    Every whole two by two block counts.  The diagonal whose means differ less is green;
    the brighter of the other two is red.
    """
    dims = frames.filter("channels = 1 AND width >= 4 AND height >= 4").select(*FRAME, "width", "height")
    j = pixels.join(dims, FRAME)
    oy, ox = F.col("y") % 2, F.col("x") % 2
    block = (F.col("y") - oy + 1 < F.col("height")) & (F.col("x") - ox + 1 < F.col("width"))

    def mean(r: int, c: int) -> Column:
        return F.avg(F.when((oy == r) & (ox == c), F.col("v"))).alias(f"m{r}{c}")

    g = j.filter(block).groupBy(*FRAME).agg(mean(0, 0), mean(0, 1), mean(1, 0), mean(1, 1))
    d1, d2 = F.abs(F.col("m00") - F.col("m11")), F.abs(F.col("m01") - F.col("m10"))
    main_green = d1 < d2
    pattern = (
        F.when(main_green & (F.col("m01") > F.col("m10")), "GRBG")
        .when(main_green, "GBRG")
        .when(F.col("m00") > F.col("m11"), "RGGB")
        .otherwise("BGGR")
    )
    small, large = F.when(main_green, d1).otherwise(d2), F.when(main_green, d2).otherwise(d1)
    diagonal = F.when(large > 0.001, 1.0 - F.least(small / large, F.lit(1.0))).otherwise(0.5)
    red_blue = F.when(main_green, d2).otherwise(d1)
    brightest = F.greatest("m00", "m01", "m10", "m11")
    separation = F.when(brightest > 0.001, F.least(red_blue / brightest, F.lit(1.0))).otherwise(0.0)
    confidence = clamp(diagonal * 0.6 + separation * 0.4, 0.0, 1.0)
    return g.select(*FRAME, pattern.alias("pattern"), confidence.alias("confidence"), "m00", "m01", "m10", "m11")


def _with_pattern(pixels: DataFrame, pattern: str | DataFrame) -> DataFrame:
    mono = pixels.drop("ch")
    if isinstance(pattern, str):
        return mono.withColumn("_pattern", F.lit(pattern))
    return mono.join(pattern.select(*FRAME, F.col("pattern").alias("_pattern")), FRAME)


def _bilinear() -> dict[int, Column]:
    """Value of each colour from the 3x3 neighbourhood, edges repeated.

    At a green site the colour found left and right comes from the row, the other one
    from the column; elsewhere green is the mean of the four sides and the opposite
    colour the mean of the corners.
    """
    own = F.col("_own")
    sides_x, sides_y = (at(0, -1) + at(0, 1)) * 0.5, (at(-1, 0) + at(1, 0)) * 0.5
    cross = (at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0)) * 0.25
    corners = (at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)) * 0.25
    beside = cfa_colour(F.col("x") + 1, F.col("y"), F.col("_pattern"))
    at_green = {c: F.when(beside == c, sides_x).otherwise(sides_y) for c in (0, 2)}
    return {
        0: F.when(own == 0, at(0, 0)).when(own == 1, at_green[0]).otherwise(corners),
        1: F.when(own == 1, at(0, 0)).otherwise(cross),
        2: F.when(own == 2, at(0, 0)).when(own == 1, at_green[2]).otherwise(corners),
    }


def _channels(df: DataFrame, values: dict[int, Column]) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), v.alias("v")) for c, v in values.items()])).alias("_c")
    return df.select(*FRAME, "y", "x", rows).select(*FRAME, "_c.ch", "y", "x", "_c.v")


def bilinear(pixels: DataFrame, pattern: str | DataFrame) -> DataFrame:
    """Bilinear demosaic. ``pattern`` is a name or a frame table with a ``pattern`` column."""
    n = neighbourhood(_with_pattern(pixels, pattern), 1, clamped=True)
    n = n.withColumn("_own", cfa_colour(F.col("x"), F.col("y"), F.col("_pattern")))
    return _channels(n, _bilinear())


# the eight directions (dx, dy): N NE E SE S SW W NW, fixed values
COMPASS = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def variable_gradients(pixels: DataFrame, pattern: str | DataFrame, per_colour_count: bool = False) -> DataFrame:
    """Demosaic from the neighbours in directions of low gradient.

    A direction counts when its gradient is at most the middle between the smallest and
    the largest.  Colour sums are divided by the number of all such directions;
    ``per_colour_count`` divides by the directions that hold the colour.  A colour
    without a positive sum comes from the bilinear form.
    """
    n = neighbourhood(_with_pattern(pixels, pattern), 2, clamped=True)
    n = n.withColumn("_own", cfa_colour(F.col("x"), F.col("y"), F.col("_pattern")))
    gradients = [
        F.abs(at(2 * dy, 2 * dx) - at(0, 0)) + F.abs(at(dy, dx) - at(-dy, -dx)) for dx, dy in COMPASS
    ]
    n = n.select("*", *[g.alias(f"_g{i}") for i, g in enumerate(gradients)])
    g = [F.col(f"_g{i}") for i in range(8)]
    low, high = F.least(*g), F.greatest(*g)
    n = n.withColumn("_limit", low + (high - low) * 0.5)

    def add(terms: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, terms)

    used = [gi <= F.col("_limit") for gi in g]

    def group(picks: tuple[int, ...], tag: str) -> list[Column]:
        """Sum and number of the used neighbours among some directions."""
        total = add([F.when(used[i], at(COMPASS[i][1], COMPASS[i][0])).otherwise(0.0) for i in picks])
        return [total.alias(f"_{tag}"), add([used[i].cast("double") for i in picks]).alias(f"_n{tag}")]

    # left/right, up/down and corner neighbours each hold one colour
    beside = cfa_colour(F.col("x") + 1, F.col("y"), F.col("_pattern"))
    n = n.select("*", beside.alias("_beside"), *group((2, 6), "h"), *group((0, 4), "v"), *group((1, 3, 5, 7), "d"))
    green = F.col("_own") == 1

    def by_colour(c: int, prefix: str) -> Column:
        h, v, d = (F.col(prefix + t) for t in "hvd")
        if c == 1:
            return F.when(green, d).otherwise(h + v)
        return F.when(green & (F.col("_beside") == c), h).when(green, v).otherwise(d)

    total = F.col("_nh") + F.col("_nv") + F.col("_nd")
    plain = _bilinear()
    values = {}
    for c in (0, 1, 2):
        summed = by_colour(c, "_")
        count = by_colour(c, "_n") if per_colour_count else total
        values[c] = F.when(F.col("_own") == c, at(0, 0)).when(summed > 0.0, summed / count).otherwise(plain[c])
    return _channels(n, values)


def auto(pixels: DataFrame, frames: DataFrame, algorithm: str = "bilinear") -> DataFrame:
    """Detect each frame's pattern, then demosaic."""
    found = detect_pattern(pixels, frames)
    return (bilinear if algorithm == "bilinear" else variable_gradients)(pixels, found)


# ---- tiles -------------------------------------------------------------------------


def _sites(pattern: str, y0: int, x0: int, h: int, w: int) -> np.ndarray:
    """Colour of each site of a tile that begins at (y0, x0)."""
    table = np.array([[CFA_PATTERNS[pattern][(r, c)] for c in (0, 1)] for r in (0, 1)])
    return table[(y0 + np.arange(h))[:, None] % 2, (x0 + np.arange(w))[None, :] % 2]


def _bilinear_tile(near, own: np.ndarray, beside: np.ndarray) -> list[np.ndarray]:
    """The rule of `_bilinear` for all sites of a tile; `near(dy, dx)` gives the samples at an offset."""
    sides_x, sides_y = (near(0, -1) + near(0, 1)) * 0.5, (near(-1, 0) + near(1, 0)) * 0.5
    cross = (near(0, -1) + near(0, 1) + near(-1, 0) + near(1, 0)) * 0.25
    corners = (near(-1, -1) + near(-1, 1) + near(1, -1) + near(1, 1)) * 0.25
    out = []
    for c in (0, 2):
        at_green = np.where(beside == c, sides_x, sides_y)
        out.append(np.where(own == c, near(0, 0), np.where(own == 1, at_green, corners)))
    return [out[0], np.where(own == 1, near(0, 0), cross), out[1]]


def _gradients_tile(near, own: np.ndarray, beside: np.ndarray, colour, per_colour_count: bool) -> list[np.ndarray]:
    """The rule of `variable_gradients` for all sites of a tile; `colour(dy, dx)` gives the sites' colours at an offset."""
    g = [np.abs(near(2 * dy, 2 * dx) - near(0, 0)) + np.abs(near(dy, dx) - near(-dy, -dx)) for dx, dy in COMPASS]
    low, high = np.minimum.reduce(g), np.maximum.reduce(g)
    limit = low + (high - low) * 0.5
    used = [gi <= limit for gi in g]
    number = sum(u.astype(float) for u in used)
    out = []
    for c, plain in enumerate(_bilinear_tile(near, own, beside)):
        holds = [u & (colour(dy, dx) == c) for u, (dx, dy) in zip(used, COMPASS)]
        total = sum(np.where(k, near(dy, dx), 0.0) for k, (dx, dy) in zip(holds, COMPASS))
        count = sum(k.astype(float) for k in holds) if per_colour_count else number
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append(np.where(own == c, near(0, 0), np.where(total > 0.0, total / count, plain)))
    return out


def demosaic_tiles(tiles: DataFrame, pattern: str | DataFrame, algorithm: str = "bilinear", side: int = TL.SIDE, per_colour_count: bool = False) -> DataFrame:
    """Mosaic tiles (`functions.tiles`) to tiles of three channels, bilinear or by gradients.

    Equal to `bilinear` and `variable_gradients` on the long table; a task sees one tile and its halo at a time.
    """
    if isinstance(pattern, str):
        known = tiles.withColumn("pattern", F.lit(pattern))
    else:
        known = tiles.join(pattern.select(*FRAME, "pattern"), FRAME)
    known = known.select(*[c for c in known.columns if c != "data"], "data")
    radius = 1 if algorithm == "bilinear" else 2

    def kernel(r: dict, block: np.ndarray) -> Iterator[tuple]:
        y0, x0, h, w = r["ty"] * side, r["tx"] * side, r["h"], r["w"]

        def near(dy: int, dx: int) -> np.ndarray:
            return TL.shifted(block, radius, dy, dx)

        def colour(dy: int, dx: int) -> np.ndarray:
            return _sites(r["pattern"], y0 + dy, x0 + dx, h, w)

        own, beside = colour(0, 0), colour(0, 1)
        planes = _bilinear_tile(near, own, beside) if radius == 1 else _gradients_tile(near, own, beside, colour, per_colour_count)
        for c, plane in enumerate(planes):
            yield *[r[k] for k in FRAME], c, r["ty"], r["tx"], h, w, r["fh"], r["fw"], plane.tobytes()

    return TL.with_halo(known, radius, kernel, TL.tile_schema(tiles), side, repeat_edge=True)
