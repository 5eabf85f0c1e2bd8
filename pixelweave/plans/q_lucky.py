"""Lucky imaging queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import Lucky
from ..model import FRAME
from ..operators import lucky as L
from ..operators import pixels as P
from ..operators import warp as W
from . import fixtures as fx
from .registry import query

INNER = "x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6"
NB = ", ".join(
    f"max(CASE WHEN b.y - a.y = {dy} AND b.x - a.x = {dx} THEN b.v END) AS n{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
)
SHARP = [
    *fx.F1,
    f"""nb AS (SELECT a.session, a.frame_id, a.y, a.x, {NB} FROM pixels a JOIN pixels b USING (session, frame_id)
      WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY ALL)""",
    """grad AS (SELECT session, frame_id, n01 + n21 + n10 + n12 - 4.0::DOUBLE * n11 AS lap,
      pow(n02 - n00 + 2.0::DOUBLE * (n12 - n10) + n22 - n20, 2) + pow(n20 - n00 + 2.0::DOUBLE * (n21 - n01) + n22 - n02, 2) AS g2 FROM nb)""",
    """sharp AS (SELECT session, frame_id, var_pop(lap) AS laplacian, avg(sqrt(g2)) AS sobel, avg(g2) AS tenengrad FROM grad GROUP BY session, frame_id)""",
    "contrast AS (SELECT session, frame_id, stddev_pop(v) AS stddev FROM pixels GROUP BY session, frame_id)",
]


def scores(spark, sf, metric="laplacian"):
    return L.frame_scores(P.luma_luminance(fx.pixels(spark, sf)), metric)


for metric in L.QUALITY_METRICS:
    src = "contrast" if metric == "stddev" else "sharp"

    @query(f"sharpness_{metric}", "session:i frame_id:i quality:d", SHARP, f"SELECT session, frame_id, {metric} AS quality FROM {src}")
    def _(spark, sf, metric=metric):
        return scores(spark, sf, metric)


@query(
    "centroid",
    "session:i frame_id:i cx:d cy:d total_flux:d",
    fx.F1,
    """SELECT session, frame_id, CASE WHEN w > 1e-6 THEN sx / w ELSE 4.0 END AS cx, CASE WHEN w > 1e-6 THEN sy / w ELSE 4.0 END AS cy, w AS total_flux
       FROM (SELECT session, frame_id, sum(x * k) AS sx, sum(y * k) AS sy, sum(k) AS w FROM (SELECT *, greatest(v - 0.1::DOUBLE, 0.0::DOUBLE) AS k FROM pixels) GROUP BY session, frame_id)""",
)
def _(spark, sf):
    return L.centroid(P.luma_luminance(fx.pixels(spark, sf)), fx.frames(spark, sf))


ROI = (2, 2, 4, 4)
S = 2
NCC = [
    *fx.F1,
    "ref AS (SELECT session, y, x, v FROM pixels WHERE frame_number = 1)",
    f"""shifts AS (SELECT dy.d AS dy, dx.d AS dx, greatest({ROI[1]} + dy.d, 0) AS cy, greatest({ROI[0]} + dx.d, 0) AS cx
      FROM range(-{S}, {S + 1}) dy(d), range(-{S}, {S + 1}) dx(d) WHERE greatest({ROI[1]} + dy.d, 0) + {ROI[3]} <= 8 AND greatest({ROI[0]} + dx.d, 0) + {ROI[2]} <= 8)""",
    f"""surf AS (SELECT p.session, p.frame_id, dx, dy, CASE WHEN stddev_pop(p.v) >= 1e-6 AND stddev_pop(ref.v) >= 1e-6
        THEN covar_pop(p.v, ref.v) / (stddev_pop(p.v) * stddev_pop(ref.v)) END AS ncc
      FROM pixels p, shifts, ref WHERE ref.session = p.session AND ref.y = p.y - cy + {ROI[1]} AND ref.x = p.x - cx + {ROI[0]}
        AND p.y - cy BETWEEN 0 AND {ROI[3] - 1} AND p.x - cx BETWEEN 0 AND {ROI[2] - 1} GROUP BY p.session, p.frame_id, dx, dy)""",
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, frame_id ORDER BY ncc DESC, dy, dx) AS r FROM surf WHERE ncc IS NOT NULL) WHERE r = 1)",
]
SUB = [
    """nbr AS (SELECT b.session, b.frame_id, b.dx, b.dy, b.ncc,
      coalesce(max(CASE WHEN s.dx = b.dx - 1 AND s.dy = b.dy THEN s.ncc END), 0) AS xl, coalesce(max(CASE WHEN s.dx = b.dx + 1 AND s.dy = b.dy THEN s.ncc END), 0) AS xr,
      coalesce(max(CASE WHEN s.dx = b.dx AND s.dy = b.dy - 1 THEN s.ncc END), 0) AS yl, coalesce(max(CASE WHEN s.dx = b.dx AND s.dy = b.dy + 1 THEN s.ncc END), 0) AS yr
      FROM best b JOIN surf s USING (session, frame_id) GROUP BY b.session, b.frame_id, b.dx, b.dy, b.ncc)""",
    f"""sub AS (SELECT session, frame_id, dx, dy, ncc,
      CASE WHEN abs(dx) < {S} AND abs(dy) < {S} AND abs(xl + xr - 2 * ncc) > 1e-6 THEN least(greatest((xl - xr) / (2 * (xl + xr - 2 * ncc)), -0.5), 0.5) ELSE 0 END AS sub_dx,
      CASE WHEN abs(dx) < {S} AND abs(dy) < {S} AND abs(yl + yr - 2 * ncc) > 1e-6 THEN least(greatest((yl - yr) / (2 * (yl + yr - 2 * ncc)), -0.5), 0.5) ELSE 0 END AS sub_dy FROM nbr)""",
]


def ncc_parts(spark, sf):
    px = fx.pixels(spark, sf, carry=("frame_number",))
    lum = px.select(*FRAME, "y", "x", "v")
    ref = px.filter("frame_number = 1").select("session", "y", "x", "v")
    fr = fx.frames(spark, sf)
    rois = fr.select(*FRAME, *[F.lit(v).alias(n) for n, v in zip(("roi_x", "roi_y", "roi_w", "roi_h"), ROI)])
    return lum, ref, rois, fr


@query("ncc_surface", "session:i frame_id:i dx:i dy:i ncc:d", NCC, "SELECT session, frame_id, dx, dy, ncc FROM surf")
def _(spark, sf):
    return L.ncc_surface(*ncc_parts(spark, sf), S)


@query("shift_search", "session:i frame_id:i dx:i dy:i ncc:d", NCC, "SELECT session, frame_id, dx, dy, ncc FROM best")
def _(spark, sf):
    return L.shift_search(*ncc_parts(spark, sf), S, subpixel=False)


@query("ncc_best_shift", "session:i frame_id:i dx:i dy:i ncc:d", NCC, "SELECT session, frame_id, dx, dy, ncc FROM best")
def _(spark, sf):
    return L.best_shift(L.ncc_surface(*ncc_parts(spark, sf), S))


@query("ncc_subpixel", "session:i frame_id:i dx:i dy:i sub_dx:d sub_dy:d", [*NCC, *SUB], "SELECT session, frame_id, dx, dy, sub_dx, sub_dy FROM sub")
def _(spark, sf):
    surface = L.ncc_surface(*ncc_parts(spark, sf), S)
    return L.refine_shift(surface, L.best_shift(surface), S)


ALIGN = [
    *NCC,
    *SUB,
    """cen AS (SELECT session, frame_id, frame_number, sum(x * greatest(v - 0.1::DOUBLE, 0)) / sum(greatest(v - 0.1::DOUBLE, 0)) AS cx,
      sum(y * greatest(v - 0.1::DOUBLE, 0)) / sum(greatest(v - 0.1::DOUBLE, 0)) AS cy FROM pixels GROUP BY session, frame_id, frame_number)""",
    """align AS (SELECT c.session, c.frame_id, coalesce(ncc >= 0.3, false) AS corr, greatest(coalesce(ncc, 0), 0) AS ncc,
      CASE WHEN ncc >= 0.3 THEN -(dx + sub_dx) ELSE r.cx - c.cx END AS dx, CASE WHEN ncc >= 0.3 THEN -(dy + sub_dy) ELSE r.cy - c.cy END AS dy
      FROM cen c JOIN cen r ON r.session = c.session AND r.frame_number = 1 LEFT JOIN sub ON sub.session = c.session AND sub.frame_id = c.frame_id)""",
]


@query(
    "alignment_with_fallback",
    "session:i frame_id:i dx:d dy:d ncc:d method:s",
    ALIGN,
    "SELECT session, frame_id, dx, dy, ncc, CASE WHEN corr THEN 'correlation' ELSE 'centroid' END AS method FROM align",
)
def _(spark, sf):
    return L.alignment(*ncc_parts(spark, sf), S)


CONFIG = Lucky(selection=0.25, min_frames=5)
RANK = "ranks AS (SELECT session, frame_id, laplacian AS quality, row_number() OVER (PARTITION BY session ORDER BY laplacian DESC, frame_id) AS rank, count(*) OVER (PARTITION BY session) AS total FROM sharp)"
SELECTED = "selected AS (SELECT * FROM ranks WHERE rank <= least(greatest(ceil(round(total * 0.25, 9)), 5), total))"


@query("select_best_frames", "session:i frame_id:i rank:i quality:d", [*SHARP, RANK, SELECTED], "SELECT session, frame_id, rank, quality FROM selected")
def _(spark, sf):
    return L.select_best(scores(spark, sf), CONFIG)


@query("best_n_buffer", "session:i frame_id:i rank:i", [*SHARP, RANK], "SELECT session, frame_id, rank FROM ranks WHERE rank <= 12")
def _(spark, sf):
    return L.best_n(scores(spark, sf), 12)


@query(
    "translate_frames",
    "session:i frame_id:i ch:i y:i x:i v:d",
    [*fx.F1, "moves AS (SELECT session, frame_id, CASE WHEN frame_id % 5 = 0 THEN 0.0 ELSE (frame_id % 7 - 3) / 2.0::DOUBLE END AS dx, CASE WHEN frame_id % 5 = 0 THEN 0.0 ELSE (frame_id % 3 - 1) * 0.75::DOUBLE END AS dy FROM vectors)",
     "points AS (SELECT * FROM (SELECT p.session, p.frame_id, p.y, p.x, p.x - dx AS sx, p.y - dy AS sy FROM pixels p JOIN moves m ON m.session = p.session AND m.frame_id = p.frame_id WHERE abs(dx) >= 0.001 OR abs(dy) >= 0.001) WHERE sx >= 0 AND sx < 7 AND sy >= 0 AND sy < 7)",
     "corner AS (" + " UNION ALL ".join(f"SELECT session, frame_id, y, x, floor(sy)::INT + {dy} AS py, floor(sx)::INT + {dx} AS px, (1 - abs(sy - (floor(sy) + {dy}))) * (1 - abs(sx - (floor(sx) + {dx}))) AS k FROM points" for dy in (0, 1) for dx in (0, 1)) + ")"],
    """SELECT c.session, c.frame_id, 0 AS ch, c.y, c.x, sum(k * p.v) AS v FROM corner c JOIN pixels p ON p.session = c.session AND p.frame_id = c.frame_id AND p.x = c.px AND p.y = c.py
       GROUP BY c.session, c.frame_id, c.y, c.x
       UNION ALL SELECT p.session, p.frame_id, 0, p.y, p.x, v FROM pixels p JOIN moves USING (session, frame_id) WHERE abs(dx) < 0.001 AND abs(dy) < 0.001""",
)
def _(spark, sf):
    i = F.col("frame_id")
    moves = fx.frames(spark, sf).select(
        *FRAME,
        F.when(i % 5 == 0, 0.0).otherwise((i % 7 - 3) / 2.0).alias("dx"),
        F.when(i % 5 == 0, 0.0).otherwise((i % 3 - 1) * 0.75).alias("dy"),
    )
    return W.translate(fx.pixels(spark, sf), moves, fx.frames(spark, sf))


OUT = "session:i ch:i y:i x:i v:d"
PICKED = "picked AS (SELECT p.*, quality FROM pixels p JOIN selected USING (session, frame_id))"


@query("lucky_stack_mean", OUT, [*SHARP, RANK, SELECTED, PICKED], "SELECT session, ch, y, x, coalesce(avg(CASE WHEN v > 0 THEN v END), 0) AS v FROM picked GROUP BY session, ch, y, x")
def _(spark, sf):
    return L.stack_selected(fx.pixels(spark, sf), L.select_best(scores(spark, sf), CONFIG), replace(CONFIG, method="mean"))


for label, p in (("median", 0.5), ("percentile", 0.3)):

    @query(
        f"lucky_stack_{label}",
        OUT,
        [*SHARP, RANK, SELECTED, PICKED],
        f"SELECT session, ch, y, x, list_sort(list(v))[round((count(*) - 1) * {p}::DOUBLE)::INT + 1] AS v FROM picked WHERE v > 0 GROUP BY session, ch, y, x",
    )
    def _(spark, sf, label=label, p=p):
        return L.stack_selected(fx.pixels(spark, sf), L.select_best(scores(spark, sf), CONFIG), replace(CONFIG, method=label, percentile=p))


@query(
    "lucky_stack_weighted",
    OUT,
    [*SHARP, RANK, SELECTED, PICKED, "lw AS (SELECT *, (quality - min(quality) OVER s) / greatest(max(quality) OVER s - min(quality) OVER s, 1e-6) + 0.1::DOUBLE AS weight FROM picked WINDOW s AS (PARTITION BY session))"],
    "SELECT session, ch, y, x, sum(weight * v) / sum(weight) AS v FROM lw WHERE v > 0 GROUP BY session, ch, y, x",
)
def _(spark, sf):
    return L.stack_selected(fx.pixels(spark, sf), L.select_best(scores(spark, sf), CONFIG), replace(CONFIG, method="weighted_mean"))


@query(
    "selection_stats",
    "session:i total_frames:i selected_frames:i min_quality:d max_quality:d mean_quality:d max_offset:d",
    [*SHARP, *[c for c in ALIGN if c not in fx.F1]],
    """SELECT session, count(*) AS total_frames, least(greatest(ceil(round(count(*) * 0.25, 9)), 5), count(*)) AS selected_frames, min(laplacian) AS min_quality,
       max(laplacian) AS max_quality, avg(laplacian) AS mean_quality, max(sqrt(dx * dx + dy * dy)) AS max_offset FROM sharp JOIN align USING (session, frame_id) GROUP BY session""",
)
def _(spark, sf):
    off = L.alignment(*ncc_parts(spark, sf), S)
    return L.selection_stats(scores(spark, sf).join(off, FRAME), CONFIG)
