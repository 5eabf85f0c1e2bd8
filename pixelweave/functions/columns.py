"""Column expressions used across operators. All of them stay inside Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DITHER_4X4, LUMA, MAD_TO_SIGMA, CFA_PATTERNS, Contrast


def clamp01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def clamp(v: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(v, low), high)


def rounded(v: Column, digits: int = 6) -> Column:
    """Round, and turn a negative zero into zero so that results compare equal."""
    return F.round(v.cast("double"), digits) + F.lit(0.0)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(LUMA[0]) * r + F.lit(LUMA[1]) * g + F.lit(LUMA[2]) * b


def luma_weight(ch: Column) -> Column:
    return F.when(ch == 0, F.lit(LUMA[0])).when(ch == 1, F.lit(LUMA[1])).otherwise(F.lit(LUMA[2]))


def quantise8(v: Column) -> Column:
    """[0,1] to 0..255, adding one half and cutting off the fraction."""
    return F.floor(clamp01(v) * 255.0 + 0.5).cast("int")


def quantise8_round(v: Column) -> Column:
    return F.round(clamp01(v) * 255.0).cast("int")


def mad_sigma(mad: Column) -> Column:
    return mad * F.lit(MAD_TO_SIGMA)


def upper_median(name: str) -> Column:
    """The element at position n div 2 of the ascending order (upper of the two middle ones).

    Ordering descending, ``percentile_disc(0.5)`` stops at exactly that element, and
    unlike a collected list it is merged from per-task counts.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def asinh_stretch(v: Column, factor: Column) -> Column:
    return F.when(factor <= 0.0, v).otherwise(F.asinh(factor * v) / F.asinh(factor))


def mtf(x: Column, m: Column) -> Column:
    """Midtone transfer curve through (0,0), (m,1/2), (1,1)."""
    curve = ((m - 1.0) * x) / ((2.0 * m - 1.0) * x - m)
    return F.when(m == 0.5, x).when(x <= 0.0, F.lit(0.0)).when(x >= 1.0, F.lit(1.0)).otherwise(curve)


def solve_midtone(median: Column, target) -> Column:
    t = target if isinstance(target, Column) else F.lit(float(target))
    denom = 2.0 * t * median - t - median
    return (
        F.when((median <= 0.0) | (t <= 0.0) | (F.abs(denom) < 1e-6), F.lit(0.5))
        .otherwise(clamp(median * (t - 1.0) / denom, 0.0001, 0.9999))
    )


def s_curve(v: Column, contrast: Contrast) -> Column:
    if contrast.disabled:
        return v
    x = clamp01(v)
    return clamp01(x + F.lit(contrast.strength) * (x - contrast.midpoint) * (4.0 * x * (1.0 - x)))


def saturation_gain(lum: Column, strength: float, peak: float, upper: float) -> Column:
    """1 + strength * L/peak * (1 - L/upper)^2 below ``upper``, 1 above."""
    fade = 1.0 - lum / upper
    return 1.0 + F.when((lum > 0.0) & (lum < upper), strength * (lum / peak) * fade * fade).otherwise(0.0)


def dither_offset(x: Column, y: Column) -> Column:
    cells = F.array(*[F.lit(v) for row in DITHER_4X4 for v in row])
    return F.element_at(cells, (F.pmod(y, F.lit(4)) * 4 + F.pmod(x, F.lit(4)) + 1).cast("int"))


def cfa_colour(x: Column, y: Column, pattern: Column | str) -> Column:
    """Colour (0 red, 1 green, 2 blue) of a sensor site."""
    odd_y, odd_x = F.pmod(y, F.lit(2)), F.pmod(x, F.lit(2))
    slot = (odd_y * 2 + odd_x + 1).cast("int")
    tables = {
        name: F.array(*[F.lit(sites[(r, c)]) for r in (0, 1) for c in (0, 1)])
        for name, sites in CFA_PATTERNS.items()
    }
    if isinstance(pattern, str):
        return F.element_at(tables[pattern], slot)
    out = None
    for name, table in tables.items():
        pick = F.element_at(table, slot)
        out = F.when(pattern == name, pick) if out is None else out.when(pattern == name, pick)
    return out


def jpeg_tier(width: Column, height: Column) -> Column:
    """Resolution tier of a client viewport, by its shorter edge."""
    edge = F.coalesce(F.least(width, height), width, height, F.lit(1080))
    return (
        F.when(edge <= 1080, "hd1080").when(edge <= 1440, "qhd1440").when(edge <= 2160, "uhd2160").otherwise("original")
    )


def watchdog_margin_s(exposure_s: Column, timeout_s) -> Column:
    """Seconds granted beyond the exposure: 5 s at zero, timeout + 10 s from 30 s on."""
    t = timeout_s if isinstance(timeout_s, Column) else F.lit(float(timeout_s))
    ceiling = F.greatest(t + 10.0, F.lit(5.0))
    return F.when(exposure_s >= 30.0, ceiling).otherwise(5.0 + (ceiling - 5.0) * (exposure_s / 30.0))
