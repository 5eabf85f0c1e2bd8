"""Similarity transforms as column expressions over rotation, scale, tx, ty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + n) for n in ("rotation", "scale", "tx", "ty"))


def forward(x: Column, y: Column, prefix: str = "") -> tuple[Column, Column]:
    rot, s, tx, ty = _cols(prefix)
    c, n = F.cos(rot), F.sin(rot)
    return s * (c * x - n * y) + tx, s * (n * x + c * y) + ty


def inverse(x: Column, y: Column, prefix: str = "") -> tuple[Column, Column]:
    rot, s, tx, ty = _cols(prefix)
    c, n = F.cos(rot), F.sin(rot)
    u, v = x - tx, y - ty
    return (c * u + n * v) / s, (c * v - n * u) / s


def matrix(prefix: str = "") -> Column:
    rot, s, tx, ty = _cols(prefix)
    c, n = s * F.cos(rot), s * F.sin(rot)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -n, tx, n, c, ty, zero, zero, one)


def from_matrix(m: Column) -> dict[str, Column]:
    return {
        "rotation": F.atan2(m[3], m[0]),
        "scale": F.sqrt(m[0] * m[0] + m[3] * m[3]),
        "tx": m[2],
        "ty": m[5],
    }


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x0 - x1, y0 - y1
    return F.sqrt(dx * dx + dy * dy)


def residual(x: Column, y: Column, ref_x: Column, ref_y: Column, prefix: str = "") -> Column:
    px, py = forward(x, y, prefix)
    return distance(px, py, ref_x, ref_y)
