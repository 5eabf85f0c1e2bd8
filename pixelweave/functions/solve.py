"""Vectorised root finding for frame-level parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..config import Stretch


def newton_factor(config: Stretch):
    """pandas UDF (median, target) -> asinh factor by damped Newton steps, bisection as fallback.

    Works on the frame table (one row per frame), all rows of a batch at once.
    """
    lo0, hi0, tol, rounds = config.min_stretch, config.max_stretch, config.tolerance, config.max_iterations

    def bisect(m: np.ndarray, t: np.ndarray) -> np.ndarray:
        lo, hi = np.full_like(m, lo0), np.full_like(m, hi0)
        found = np.full_like(m, np.nan)
        for _ in range(rounds):
            mid = (lo + hi) / 2.0
            out = np.arcsinh(mid * m) / np.arcsinh(mid)
            low = out < t
            close = np.abs(out - t) < tol
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
            done = close | ((hi - lo) / mid < tol)
            found = np.where(np.isnan(found) & done, mid, found)
        return np.where(np.isnan(found), (lo + hi) / 2.0, found)

    @F.pandas_udf("double")
    def solve(median: pd.Series, target: pd.Series) -> pd.Series:
        m, t = median.to_numpy("float64"), target.to_numpy("float64")
        s = np.clip(t / np.maximum(m, 1e-300), lo0, hi0)
        done = np.zeros(len(m), dtype=bool)
        for _ in range(rounds):
            a, b = np.arcsinh(s * m), np.arcsinh(s)
            error = a / b - t
            done |= np.abs(error) < tol
            slope = (m / np.sqrt(1.0 + (s * m) ** 2) * b - a / np.sqrt(1.0 + s * s)) / (b * b)
            flat = np.abs(slope) < 1e-8
            step = s - 0.8 * error / np.where(flat, 1.0, slope)
            step = np.where(flat, np.where(error > 0, s * 0.5, s * 2.0), step)
            s = np.where(done, s, np.clip(step, lo0, hi0))
        out = np.where(done, s, bisect(m, t))
        out = np.where(m >= t, lo0, out)
        return pd.Series(np.where(m <= 1e-6, 1.0, out))

    return solve
