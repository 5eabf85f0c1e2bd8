"""Lucky imaging: sharpness, alignment, selection and stacking of the best frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Lucky
from ..functions import scan
from ..functions import tiles as TL
from ..functions.columns import clamp
from ..functions.stencil import at, neighbourhood
from ..model import FRAME, PIXEL

QUALITY_METRICS = ("laplacian", "sobel", "tenengrad", "stddev")


def sharpness(luminance: DataFrame) -> DataFrame:
    """All four measures per frame from one neighbourhood pass.

    laplacian: variance of the 4-neighbour Laplacian; sobel: mean gradient magnitude;
    tenengrad: mean squared gradient, each over interior pixels; stddev: contrast.
    """
    n = neighbourhood(luminance, 1, clamped=False)
    gx = (at(-1, 1) - at(-1, -1)) + 2.0 * (at(0, 1) - at(0, -1)) + (at(1, 1) - at(1, -1))
    gy = (at(1, -1) - at(-1, -1)) + 2.0 * (at(1, 0) - at(-1, 0)) + (at(1, 1) - at(-1, 1))
    lap = at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1) - 4.0 * at(0, 0)
    interior = at(-1, -1).isNotNull() & at(1, 1).isNotNull()
    t = n.select(*FRAME, "v", F.when(interior, lap).alias("_lap"), F.when(interior, gx * gx + gy * gy).alias("_g2"))
    return t.groupBy(*FRAME).agg(
        F.coalesce(F.var_pop("_lap"), F.lit(0.0)).alias("laplacian"),
        F.coalesce(F.avg(F.sqrt("_g2")), F.lit(0.0)).alias("sobel"),
        F.coalesce(F.avg("_g2"), F.lit(0.0)).alias("tenengrad"),
        F.stddev_pop("v").alias("stddev"),
    )


def sharpness_tiles(tiles: DataFrame, side: int = TL.SIDE) -> DataFrame:
    """`sharpness` from luminance tiles: a task sees one tile and its halo; sums and spreads per tile are added up.

    Spreads are taken about each tile's own mean first, so large means do not cancel.
    """
    names = ("lap", "root", "square", "value")
    fields = [T.StructField(f"{a}_{n}", T.DoubleType()) for n in names for a in ("n", "mean", "m2")]
    schema = T.StructType([*[tiles.schema[n] for n in FRAME], *fields])

    def kernel(r: dict, block: np.ndarray) -> Iterator[tuple]:
        def near(dy: int, dx: int) -> np.ndarray:
            return TL.shifted(block, 1, dy, dx)

        gx = (near(-1, 1) - near(-1, -1)) + 2.0 * (near(0, 1) - near(0, -1)) + (near(1, 1) - near(1, -1))
        gy = (near(1, -1) - near(-1, -1)) + 2.0 * (near(1, 0) - near(-1, 0)) + (near(1, 1) - near(-1, 1))
        lap = near(-1, 0) + near(1, 0) + near(0, -1) + near(0, 1) - 4.0 * near(0, 0)
        own = ~np.isnan(near(0, 0))
        interior = own & ~np.isnan(near(-1, -1)) & ~np.isnan(near(1, 1))
        square = gx * gx + gy * gy
        out = []
        for v, use in ((lap, interior), (np.sqrt(square), interior), (square, interior), (near(0, 0), own)):
            v = v[use & ~np.isnan(v)]
            mean = v.mean() if v.size else 0.0
            out += [float(v.size), float(mean), float(((v - mean) ** 2).sum())]
        yield *[r[k] for k in FRAME], *out

    parts = TL.with_halo(tiles, 1, kernel, schema, side)
    sums = parts.groupBy(*FRAME).agg(
        *[F.sum(f"n_{n}").alias(f"n_{n}") for n in names],
        *[F.sum(F.col(f"n_{n}") * F.col(f"mean_{n}")).alias(f"s_{n}") for n in names],
        *[F.sum(F.col(f"m2_{n}") + F.col(f"n_{n}") * F.col(f"mean_{n}") ** 2).alias(f"q_{n}") for n in names],
    )
    mean = lambda n: F.try_divide(F.col(f"s_{n}"), F.col(f"n_{n}"))
    spread = lambda n: F.greatest(F.try_divide(F.col(f"q_{n}"), F.col(f"n_{n}")) - mean(n) ** 2, F.lit(0.0))
    none = F.lit(0.0)
    return sums.select(
        *FRAME,
        F.coalesce(spread("lap"), none).alias("laplacian"),
        F.coalesce(mean("root"), none).alias("sobel"),
        F.coalesce(mean("square"), none).alias("tenengrad"),
        F.sqrt(spread("value")).alias("stddev"),
    )


def frame_scores(luminance: DataFrame, metric: str) -> DataFrame:
    if metric == "stddev":
        return luminance.groupBy(*FRAME).agg(F.stddev_pop("v").alias("quality"))
    return sharpness(luminance).select(*FRAME, F.col(metric).alias("quality"))


CENTROID_THRESHOLD = 0.1


def centroid(luminance: DataFrame, frames: DataFrame) -> DataFrame:
    """Centroid of (v - 0.1) where v > 0.1; the frame centre where nothing is brighter."""
    w = F.when(F.col("v") > CENTROID_THRESHOLD, F.col("v") - CENTROID_THRESHOLD).otherwise(0.0)
    g = luminance.groupBy(*FRAME).agg(
        F.sum(F.col("x") * w).alias("_x"), F.sum(F.col("y") * w).alias("_y"), F.sum(w).alias("_w")
    )
    j = frames.select(*FRAME, "width", "height").join(g, FRAME, "left")
    lit = F.col("_w") > 1e-6
    return j.select(
        *FRAME,
        F.when(lit, F.col("_x") / F.col("_w")).otherwise(F.col("width") / 2.0).alias("cx"),
        F.when(lit, F.col("_y") / F.col("_w")).otherwise(F.col("height") / 2.0).alias("cy"),
        F.coalesce("_w", F.lit(0.0)).alias("total_flux"),
    )


def ncc_surface(luminance: DataFrame, reference: DataFrame, rois: DataFrame, frames: DataFrame, search: int) -> DataFrame:
    """Normalised cross-correlation of each frame with its session's reference per shift.

    ``reference``: session, y, x, v.  ``rois``: frame, roi_x, roi_y, roi_w, roi_h.
    Shifts that leave the frame are absent; a negative shifted corner is moved to 0.
    A flat reference or frame region gives a NULL ``ncc``.

    Each frame pixel finds the shifts whose region holds it and the reference pixel it
    meets, so the join is an equi-join on (session, y, x) and the sums merge early.
    """
    region = rois.select(*FRAME, "roi_x", "roi_y", "roi_w", "roi_h").join(frames.select(*FRAME, "width", "height"), FRAME)
    steps = F.sequence(F.lit(-search), F.lit(search))
    px = luminance.select(*FRAME, "y", "x", "v").join(region, FRAME)
    # cut to what any shift can reach before shifts multiply the rows
    near = (
        (F.col("x") >= F.greatest(F.col("roi_x") - search, F.lit(0)))
        & (F.col("x") < F.col("roi_x") + F.col("roi_w") + search)
        & (F.col("y") >= F.greatest(F.col("roi_y") - search, F.lit(0)))
        & (F.col("y") < F.col("roi_y") + F.col("roi_h") + search)
    )
    s = px.filter(near).withColumn("dy", F.explode(steps))
    corner_y = F.greatest(F.col("roi_y") + F.col("dy"), F.lit(0))
    ry = F.col("y") - corner_y
    s = s.filter((corner_y + F.col("roi_h") <= F.col("height")) & (ry >= 0) & (ry < F.col("roi_h"))).withColumn("_ry", ry + F.col("roi_y"))
    s = s.withColumn("dx", F.explode(steps))
    corner_x = F.greatest(F.col("roi_x") + F.col("dx"), F.lit(0))
    rx = F.col("x") - corner_x
    s = s.filter((corner_x + F.col("roi_w") <= F.col("width")) & (rx >= 0) & (rx < F.col("roi_w"))).withColumn("_rx", rx + F.col("roi_x"))
    ref = reference.select("session", F.col("y").alias("_ry"), F.col("x").alias("_rx"), F.col("v").alias("_ref"))
    g = s.join(ref, ["session", "_ry", "_rx"]).groupBy(*FRAME, "dy", "dx").agg(
        F.covar_pop("v", "_ref").alias("_cov"), F.stddev_pop("v").alias("_sf"), F.stddev_pop("_ref").alias("_sr")
    )
    flat = (F.col("_sf") < 1e-6) | (F.col("_sr") < 1e-6)
    return g.select(*FRAME, "dx", "dy", F.when(~flat, F.col("_cov") / (F.col("_sf") * F.col("_sr"))).alias("ncc"))


def best_shift(surface: DataFrame) -> DataFrame:
    """Shift of the largest ncc; the first in (dy, dx) order wins a tie."""
    return surface.filter("ncc IS NOT NULL").groupBy(*FRAME).agg(
        F.max_by(F.struct("dx", "dy"), F.struct(F.col("ncc"), -F.col("dy"), -F.col("dx"))).alias("_b"), F.max("ncc").alias("ncc")
    ).select(*FRAME, "_b.dx", "_b.dy", "ncc")


# samples, or shifts, that one transform of several frames' regions covers
SLAB = 1 << 18
GEOMETRY = ("roi_x", "roi_y", "roi_w", "roi_h", "width", "height")


def _placements(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums of every h x w window of each frame in ``a`` (frame, y, x), from running sums."""
    s = np.pad(a, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)
    return s[:, h:, w:] - s[:, :-h, w:] - s[:, h:, :-w] + s[:, :-h, :-w]


def _best_by_fft(area: np.ndarray, ref: np.ndarray, corner: tuple[int, int], roi: tuple[int, ...], search: int, subpixel: bool) -> tuple[np.ndarray, ...]:
    """(which frames have a shift, dx, dy, ncc, sub_dx, sub_dy) from correlations of all shifts at once.

    ``area``, ``ref``: the samples (frame, y, x) around regions ``roi`` of one size and place, from ``corner`` (y, x) on.
    Cross terms come from a Fourier transform, means and deviations of every placement from running sums.
    """
    rx, ry, rw, rh = roi
    y0, x0 = corner
    patch = ref[:, ry - y0 : ry - y0 + rh, rx - x0 : rx - x0 + rw]
    patch = patch - patch.mean((1, 2), keepdims=True)
    sr, n = patch.std((1, 2), keepdims=True), rh * rw
    base = area - area.mean((1, 2), keepdims=True)
    shape = base.shape[1:]
    cross = np.fft.irfft2(np.fft.rfft2(base) * np.conj(np.fft.rfft2(patch, shape)), shape)
    mean = _placements(base, rh, rw) / n
    std = np.sqrt(np.maximum(_placements(base * base, rh, rw) / n - mean * mean, 0.0))
    _, high, wide = mean.shape
    with np.errstate(all="ignore"):
        placed = np.where((std >= 1e-6) & (sr >= 1e-6), cross[:, :high, :wide] / (n * sr * std), np.nan)
    steps = np.arange(-search, search + 1)
    cy, cx = np.maximum(ry + steps, 0) - y0, np.maximum(rx + steps, 0) - x0
    surface = placed[:, np.minimum(cy, high - 1)[:, None], np.minimum(cx, wide - 1)[None, :]]
    surface = np.where((cy < high)[:, None] & (cx < wide)[None, :], surface, np.nan)
    some = ~np.isnan(surface).all((1, 2))
    surface = surface[some]
    # equal up to rounding counts as a tie, and the first in (dy, dx) order wins
    top = np.nanmax(surface, (1, 2), initial=-np.inf)
    iy, ix = np.divmod((surface >= top[:, None, None] - 1e-9).reshape(len(top), len(steps) ** 2).argmax(1), len(steps))
    sub = np.zeros((2, len(top)))
    if subpixel and search:
        inner = (ix > 0) & (ix < 2 * search) & (iy > 0) & (iy < 2 * search)
        k, y, x = np.flatnonzero(inner), iy[inner], ix[inner]
        c = np.nan_to_num(surface)
        for i, (lo, hi) in enumerate(((c[k, y, x - 1], c[k, y, x + 1]), (c[k, y - 1, x], c[k, y + 1, x]))):
            denom = lo + hi - 2.0 * c[k, y, x]
            bent = np.abs(denom) > 1e-6
            sub[i, k] = np.where(bent, np.clip((lo - hi) / np.where(bent, 2.0 * denom, 1.0), -0.5, 0.5), 0.0)
    return some, ix - search, iy - search, top, sub[0], sub[1]


def _begins(rows: pa.Table | pa.RecordBatch, before: pa.RecordBatch | None = None) -> np.ndarray:
    """Rows that begin a frame; ``before`` is the batch that came just before."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = before is None
    for c in FRAME:
        key = rows[c]
        new[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        if before is not None:
            new[0] |= key[0] != before[c][-1]
    return new


def _best_of_frames(rows: pa.Table, schema: pa.Schema, search: int, subpixel: bool) -> Iterator[pa.RecordBatch]:
    """Best shifts of the whole frames in ``rows``; frames whose regions have one size and place are transformed together."""
    starts = np.flatnonzero(_begins(rows))
    ends = np.append(starts[1:], rows.num_rows)
    col = {c: rows[c].to_numpy() for c in (*GEOMETRY, "y", "x", "v", "_ref")}
    col["_ref"] = np.where(np.isnan(col["_ref"]), 0.0, col["_ref"])
    kinds, kind = np.unique(np.stack([col[c][starts] for c in GEOMETRY], 1), axis=0, return_inverse=True)
    for at, (rx, ry, rw, rh, width, height) in enumerate(kinds.tolist()):
        y0, x0 = max(ry - search, 0), max(rx - search, 0)
        high, wide = min(ry + rh + search, height) - y0, min(rx + rw + search, width) - x0
        if min(rh, rw) < 1 or rh > high or rw > wide:
            continue
        frames = np.flatnonzero(kind.reshape(-1) == at)
        step = max(1, SLAB // max(high * wide, (2 * search + 1) ** 2))
        for part in np.split(frames, range(step, len(frames), step)):
            size = ends[part] - starts[part]
            which = np.repeat(np.arange(len(part)), size)
            own = np.arange(len(which)) + np.repeat(starts[part] - np.cumsum(size) + size, size)
            area, met = np.zeros((2, len(part), high, wide))
            place = which, col["y"][own] - y0, col["x"][own] - x0
            area[place], met[place] = col["v"][own], col["_ref"][own]
            some, *best = _best_by_fft(area, met, (y0, x0), (rx, ry, rw, rh), search, subpixel)
            keys = rows.select(FRAME).take(starts[part][some])
            out = [*keys.columns, *map(pa.array, best)]
            yield from pa.table([c.cast(f.type) for c, f in zip(out, schema)], schema=schema).to_batches()


def _search_batches(schema: T.StructType, search: int, subpixel: bool):
    """Function over batches of samples that lie together by frame; it holds two batches, or the rows of one frame."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(_begins(batch, held[-1] if held else None))
            if held and len(new):
                yield from _best_of_frames(pa.Table.from_batches([*held, batch.slice(0, new[-1])]), arrow, search, subpixel)
                held, batch = [], batch.slice(new[-1])
            held.append(batch)
        if held:
            yield from _best_of_frames(pa.Table.from_batches(held), arrow, search, subpixel)

    return run


def shift_search(luminance: DataFrame, reference: DataFrame, rois: DataFrame, frames: DataFrame, search: int, subpixel: bool = True) -> DataFrame:
    """Best shift with its sub-pixel part, for any search radius.

    With shifts as rows a region would be repeated (2*search+1)^2 times; here a frame's region (bounded by the
    region plus the search radius) lies together in a task, which transforms many small ones at once.
    """
    region = rois.select(*FRAME, "roi_x", "roi_y", "roi_w", "roi_h").join(frames.select(*FRAME, "width", "height"), FRAME)
    px = luminance.select(*FRAME, "y", "x", "v").join(region, FRAME)
    near = (
        (F.col("x") >= F.col("roi_x") - search)
        & (F.col("x") < F.col("roi_x") + F.col("roi_w") + search)
        & (F.col("y") >= F.col("roi_y") - search)
        & (F.col("y") < F.col("roi_y") + F.col("roi_h") + search)
    )
    ref = reference.select("session", "y", "x", F.col("v").cast("double").alias("_ref"))
    j = px.filter(near).join(ref, ["session", "y", "x"], "left").repartition(*FRAME).sortWithinPartitions(*FRAME)
    best = [T.StructField(n, T.IntegerType()) for n in ("dx", "dy")] + [T.StructField(n, T.DoubleType()) for n in ("ncc", "sub_dx", "sub_dy")]
    schema = T.StructType([*[luminance.schema[c] for c in FRAME], *best])
    return j.mapInArrow(_search_batches(schema, search, subpixel), schema)


def parabola(c0: Column, c1: Column, c2: Column) -> Column:
    denom = c0 + c2 - 2.0 * c1
    return clamp(F.when(F.abs(denom) > 1e-6, (c0 - c2) / (2.0 * denom)).otherwise(0.0), -0.5, 0.5)


def refine_shift(surface: DataFrame, best: DataFrame, search: int) -> DataFrame:
    """Add sub-pixel parts from a parabola through the neighbouring correlations.

    Neighbours without a value count as 0; a best shift on the edge is not refined.
    """
    b = best.select(*FRAME, F.col("dx").alias("_bx"), F.col("dy").alias("_by"))
    j = surface.join(b, FRAME)
    ox, oy = F.col("dx") - F.col("_bx"), F.col("dy") - F.col("_by")

    def value(x: int, y: int) -> Column:
        return F.coalesce(F.max(F.when((ox == x) & (oy == y), F.col("ncc"))), F.lit(0.0))

    g = j.filter((F.abs(ox) <= 1) & (F.abs(oy) <= 1)).groupBy(*FRAME).agg(
        parabola(value(-1, 0), value(0, 0), value(1, 0)).alias("_sx"),
        parabola(value(0, -1), value(0, 0), value(0, 1)).alias("_sy"),
    )
    inner = (F.abs("dx") < search) & (F.abs("dy") < search)
    return best.join(g, FRAME).select(
        *FRAME,
        "dx",
        "dy",
        "ncc",
        F.when(inner, F.col("_sx")).otherwise(0.0).alias("sub_dx"),
        F.when(inner, F.col("_sy")).otherwise(0.0).alias("sub_dy"),
    )


def alignment(
    luminance: DataFrame,
    reference: DataFrame,
    rois: DataFrame,
    frames: DataFrame,
    search: int,
    subpixel: bool = True,
) -> DataFrame:
    """Offset (dx, dy) that moves each frame onto the reference, with ncc and method.

    The correlation result is negated.  Where the reference region is flat or the best
    correlation stays under 0.3 the difference of centroids is used.
    """
    refined = shift_search(luminance, reference, rois, frames, search, subpixel)
    own = centroid(luminance, frames)
    dims = frames.groupBy("session").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    ref_frames = dims.withColumn("frame_id", F.lit(0).cast("long"))
    ref_c = centroid(reference.withColumn("frame_id", F.lit(0).cast("long")), ref_frames).select(
        "session", F.col("cx").alias("_rx"), F.col("cy").alias("_ry")
    )
    j = own.join(ref_c, "session").join(refined.withColumnsRenamed({"dx": "_dx", "dy": "_dy"}), FRAME, "left")
    ncc = F.greatest(F.coalesce("ncc", F.lit(0.0)), F.lit(0.0))
    correlated = F.coalesce(ncc >= 0.3, F.lit(False))
    return j.select(
        *FRAME,
        F.when(correlated, -(F.col("_dx") + F.col("sub_dx"))).otherwise(F.col("_rx") - F.col("cx")).alias("dx"),
        F.when(correlated, -(F.col("_dy") + F.col("sub_dy"))).otherwise(F.col("_ry") - F.col("cy")).alias("dy"),
        ncc.alias("ncc"),
        F.when(correlated, "correlation").otherwise("centroid").alias("method"),
    )


# ---- selection -------------------------------------------------------------------


def selected_count(total: Column, config: Lucky) -> Column:
    """min(max(ceil(total * selection), min_frames), total), capped by max_frames."""
    n = F.least(F.greatest(F.ceil(F.round(total * config.selection, 9)), F.lit(config.min_frames)), total)
    return F.least(n, F.lit(config.max_frames)) if config.max_frames > 0 else n


def ranked(scores: DataFrame) -> DataFrame:
    """Rank of each frame in its session by quality, best first, then frame id.

    Range blocks spread a large session over many tasks.
    """
    s = scores.withColumn("_worse", -F.col("quality"))
    blocked = scan.range_blocks(s, ["session"], [F.col("_worse"), F.col("frame_id")])
    return scan.numbered(blocked, ["session"], ["_worse", "frame_id"], "rank").drop("_worse", scan.BLOCK)


def select_best(scores: DataFrame, config: Lucky = Lucky()) -> DataFrame:
    """Best frames of each session with their rank."""
    totals = scores.groupBy("session").agg(F.count("*").alias("_total"))
    r = ranked(scores).join(totals, "session")
    return r.filter(F.col("rank") <= selected_count(F.col("_total"), config)).drop("_total")


def best_n(scores: DataFrame, n: int) -> DataFrame:
    """What a buffer of n frames holds after all frames passed: a frame enters only when
    strictly better than the worst, so of equal frames the earlier one stays."""
    return ranked(scores).filter(F.col("rank") <= n)


def selection_stats(scores: DataFrame, config: Lucky = Lucky()) -> DataFrame:
    """Totals per session; ``scores``: session, frame_id, quality, dx, dy."""
    g = scores.groupBy("session").agg(
        F.count("*").alias("total_frames"),
        F.min("quality").alias("min_quality"),
        F.max("quality").alias("max_quality"),
        F.avg("quality").alias("mean_quality"),
        F.max(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("max_offset"),
    )
    return g.withColumn("selected_frames", selected_count(F.col("total_frames"), config).cast("long"))


# ---- stacking ----------------------------------------------------------------------


def stack_mean(pixels: DataFrame) -> DataFrame:
    """Mean of the positive samples per pixel, 0 without any."""
    return pixels.groupBy(*PIXEL).agg(F.coalesce(F.avg(F.when(F.col("v") > 0, F.col("v"))), F.lit(0.0)).alias("v"))


def stack_percentile(pixels: DataFrame, p: float = 0.5) -> DataFrame:
    """Element at round((n-1)*p), half up, of the positive samples of each pixel.

    Ranks come from a sort that can spill; no list of samples is built.
    """
    positive = F.col("v") > 0
    up = Window.partitionBy(*PIXEL).orderBy(~positive, "v")
    n = F.sum(positive.cast("int")).over(Window.partitionBy(*PIXEL))
    t = pixels.select(*PIXEL, "v", (F.row_number().over(up) - 1).alias("_r"), n.alias("_n"))
    wanted = F.greatest(F.round((F.col("_n") - 1) * F.lit(float(p))).cast("int"), F.lit(0))
    return t.filter(F.col("_r") == wanted).select(*PIXEL, F.when(F.col("_n") > 0, F.col("v")).otherwise(0.0).alias("v"))


def quality_mean_weights(selected: DataFrame) -> DataFrame:
    """(q - min)/max(range, 1e-6) + 0.1 over the selected frames of a session."""
    lim = selected.groupBy("session").agg(F.min("quality").alias("_lo"), F.max("quality").alias("_hi"))
    w = (F.col("quality") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6)) + 0.1
    return selected.join(lim, "session").withColumn("weight", w).drop("_lo", "_hi")


def stack_weighted_mean(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    j = pixels.join(weights.select(*FRAME, "weight"), FRAME)
    w = F.when(F.col("v") > 0, F.col("weight")).otherwise(0.0)
    g = j.groupBy(*PIXEL).agg(F.sum(w * F.col("v")).alias("_s"), F.sum(w).alias("_w"))
    return g.select(*PIXEL, F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(0.0).alias("v"))


def stack_selected(pixels: DataFrame, selected: DataFrame, config: Lucky) -> DataFrame:
    """Stack the (already aligned) pixels of the selected frames by the configured method."""
    kept = pixels.join(selected.select(*FRAME), FRAME, "left_semi")
    if config.method == "mean":
        return stack_mean(kept)
    if config.method == "weighted_mean":
        return stack_weighted_mean(kept, quality_mean_weights(selected))
    return stack_percentile(kept, 0.5 if config.method == "median" else config.percentile)
