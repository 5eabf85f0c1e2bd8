"""Tone queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import CONTRAST, STRETCH, Contrast, Saturation, Stats, Stretch
from ..functions.columns import solve_midtone
from ..model import FRAME
from ..operators import stats as S
from ..operators import tone as R
from . import fixtures as fx
from .q_statistics import BGMODE, LUM, ROBUST
from .registry import query

PX = "session:i frame_id:i ch:i y:i x:i v:d"
SRC = "src AS (SELECT * FROM mosaic)"
M3 = [*fx.F3M, SRC, ROBUST]
RGBW = "rgbw AS (SELECT session, frame_id, y, x, max(CASE WHEN ch = 0 THEN v END) AS r, max(CASE WHEN ch = 1 THEN v END) AS g, max(CASE WHEN ch = 2 THEN v END) AS b FROM {src} GROUP BY session, frame_id, y, x)"
L = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"


def c01(e: str) -> str:
    return f"least(greatest({e}, 0.0::DOUBLE), 1.0::DOUBLE)"


def melt(src: str, exprs: dict[str, str] | None = None) -> str:
    exprs = exprs or {c: c for c in "rgb"}
    return " UNION ALL ".join(f"SELECT session, frame_id, {i} AS ch, y, x, {exprs[c]} AS v FROM {src}" for i, c in enumerate("rgb"))


def coloured(curve: str, k: float = 1.0, src: str = "lums") -> str:
    """curve is SQL over ``l``."""
    return melt(src, {c: f"CASE WHEN l <= 1e-8 THEN 0.0::DOUBLE ELSE {c01(f'{c} * (({curve}) / l) * {k}::DOUBLE + ({curve}) * (1.0::DOUBLE - {k}::DOUBLE)')} END" for c in "rgb"})


LUMS = f"lums AS (SELECT *, {L} AS l FROM rgbw)"
NEUTRAL = "mult AS (SELECT session, frame_id, ch, least(greatest(CASE WHEN median > 1e-6 THEN avg(median) OVER (PARTITION BY session, frame_id) / median ELSE 1 END, 0.5), 2.0) AS multiplier FROM rstats)"


@query("neutral_multipliers", "session:i frame_id:i ch:i multiplier:d", [*M3, NEUTRAL], "SELECT * FROM mult")
def _(spark, sf):
    return R.neutral_multipliers(S.image_stats(*fx.mosaic(spark, sf, 3)))


@query("neutralise_background", PX, [*M3, NEUTRAL], f"SELECT session, frame_id, ch, y, x, {c01('v * multiplier')} AS v FROM mosaic JOIN mult USING (session, frame_id, ch)")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return R.apply_multipliers(px, R.neutral_multipliers(S.image_stats(px, fr)))


@query(
    "grid_white_balance",
    "session:i frame_id:i ch:i multiplier:d",
    [
        *fx.F3M,
        "blocks AS (SELECT session, frame_id, ch, median(v) AS m FROM mosaic GROUP BY session, frame_id, ch, least(y // 9, 4), least(x // 9, 4))",
        "levels AS (SELECT session, frame_id, ch, list_sort(list(m))[9] AS level FROM blocks GROUP BY session, frame_id, ch)",
    ],
    """SELECT l.session, l.frame_id, l.ch, least(greatest(CASE WHEN l.ch = 1 THEN 1.0 WHEN l.level > 1e-6 THEN greatest(g.level, 1e-6) / l.level ELSE 1 END, 0.5), 2.0) AS multiplier
       FROM levels l JOIN levels g ON g.session = l.session AND g.frame_id = l.frame_id AND g.ch = 1""",
)
def _(spark, sf):
    return R.grid_white_balance(*fx.mosaic(spark, sf, 3), 5, 35.0)


MODES = """bins AS (SELECT session, frame_id, ch, least(greatest(floor(v * 65535.0::DOUBLE), 0), 65535)::INT AS bin, count(*) AS n FROM mosaic GROUP BY ALL),
modes AS (SELECT session, frame_id, ch, bin / 65535.0::DOUBLE AS mode FROM (SELECT *, row_number() OVER (PARTITION BY session, frame_id, ch ORDER BY n DESC, bin) AS r FROM bins WHERE bin >= 10) WHERE r = 1),
bps AS (SELECT session, frame_id, ch, greatest(mode - 2.0::DOUBLE * sigma, 0.0::DOUBLE) AS black_point FROM modes JOIN rstats USING (session, frame_id, ch))"""


@query("channel_black_points", "session:i frame_id:i ch:i black_point:d", [*M3, MODES], "SELECT * FROM bps")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return R.channel_black_points(px, fr, S.image_stats(px, fr))


LBP = "lbp AS (SELECT session, frame_id, greatest(mode - 2.0::DOUBLE * sg, 0.0::DOUBLE) AS black_point FROM bgmode JOIN (SELECT session, frame_id, avg(sigma) AS sg FROM rstats GROUP BY session, frame_id) USING (session, frame_id))"


@query("luminance_black_point", "session:i frame_id:i black_point:d", [*M3, LUM, BGMODE, LBP], "SELECT * FROM lbp")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return R.luminance_black_point(px, fr, S.image_stats(px, fr))


@query("subtract_black_points", PX, [*M3, MODES], "SELECT session, frame_id, ch, y, x, greatest(v - black_point, 0.0::DOUBLE) AS v FROM mosaic JOIN bps USING (session, frame_id, ch)")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return R.subtract_black_point(px, R.channel_black_points(px, fr, S.image_stats(px, fr)))


@query("subtract_black_uniform", PX, [*M3, LUM, BGMODE, LBP], "SELECT session, frame_id, ch, y, x, greatest(v - black_point, 0.0::DOUBLE) AS v FROM mosaic JOIN lbp USING (session, frame_id)")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return R.subtract_black_point(px, R.luminance_black_point(px, fr, S.image_stats(px, fr)))


ASINH = "(asinh(12.0::DOUBLE * {v}) / asinh(12.0::DOUBLE))"
MTF = "CASE WHEN {v} <= 0 THEN 0.0::DOUBLE WHEN {v} >= 1 THEN 1.0::DOUBLE ELSE (({m} - 1.0::DOUBLE) * {v}) / ((2.0::DOUBLE * {m} - 1.0::DOUBLE) * {v} - {m}) END"


def strength(fr, value):
    return fr.select(*FRAME, "channels", F.lit(value).alias("strength"))


@query("stretch_asinh_mono", PX, fx.F1, f"SELECT session, frame_id, ch, y, x, CASE WHEN v <= 1e-8 THEN 0 ELSE {c01(ASINH.format(v='v'))} END AS v FROM pixels")
def _(spark, sf):
    return R.stretch_frames(fx.pixels(spark, sf), strength(fx.frames(spark, sf), 12.0))


@query("stretch_mtf_mono", PX, fx.F1, f"SELECT session, frame_id, ch, y, x, {c01(MTF.format(v='v', m='0.2::DOUBLE'))} AS v FROM pixels")
def _(spark, sf):
    return R.stretch_frames(fx.pixels(spark, sf), strength(fx.frames(spark, sf), 0.2), "mtf")


@query("stretch_asinh_colour", PX, [*fx.F3, RGBW.format(src="rgb"), LUMS], coloured(ASINH.format(v="l"), 0.7))
def _(spark, sf):
    px, fr = fx.rgb(spark, sf)
    return R.stretch_frames(px, strength(fr, 12.0), "asinh", 0.7)


@query("stretch_mtf_colour", PX, [*fx.F3, RGBW.format(src="rgb"), LUMS], coloured(MTF.format(v="l", m="0.2::DOUBLE"), 1.0))
def _(spark, sf):
    px, fr = fx.rgb(spark, sf)
    return R.stretch_frames(px, strength(fr, 0.2), "mtf")


@query(
    "solve_midtone",
    "session:i frame_id:i m:d",
    fx.F1,
    """SELECT session, frame_id, CASE WHEN x <= 0 OR abs(2 * 0.25::DOUBLE * x - 0.25::DOUBLE - x) < 1e-6 THEN 0.5 ELSE least(greatest(x * (0.25::DOUBLE - 1) / (2 * 0.25::DOUBLE * x - 0.25::DOUBLE - x), 0.0001), 0.9999) END AS m
       FROM (SELECT session, frame_id, median(v) AS x FROM pixels GROUP BY session, frame_id)""",
)
def _(spark, sf):
    med = fx.pixels(spark, sf).groupBy(*FRAME).agg(F.median("v").alias("x"))
    return med.withColumn("m", solve_midtone(F.col("x"), 0.25))


SOLVE = """med AS (SELECT session, frame_id, min(v) / 20.0::DOUBLE + 0.001::DOUBLE AS m FROM pixels GROUP BY session, frame_id),
it AS (SELECT session, frame_id, m, 0 AS k, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, NULL::DOUBLE AS hit FROM med
  UNION ALL
  SELECT session, frame_id, m, k + 1, CASE WHEN o < 0.1::DOUBLE THEN mid ELSE lo END, CASE WHEN o < 0.1::DOUBLE THEN hi ELSE mid END,
    coalesce(hit, CASE WHEN abs(o - 0.1::DOUBLE) < 0.001::DOUBLE OR ((CASE WHEN o < 0.1::DOUBLE THEN hi ELSE mid END) - (CASE WHEN o < 0.1::DOUBLE THEN mid ELSE lo END)) / mid < 0.001::DOUBLE THEN mid END)
  FROM (SELECT *, (lo + hi) / 2.0::DOUBLE AS mid, asinh((lo + hi) / 2.0::DOUBLE * m) / asinh((lo + hi) / 2.0::DOUBLE) AS o FROM it WHERE k < {n}))"""


def medians(spark, sf):
    return fx.pixels(spark, sf).groupBy(*FRAME).agg((F.min("v") / 20.0 + 0.001).alias("m"))


@query("solve_factor_bisection", "session:i frame_id:i factor:d", [*fx.F1, SOLVE.format(lo=0.1, hi=100.0, n=50)], "SELECT session, frame_id, CASE WHEN m >= 0.1 THEN 0.1 ELSE coalesce(hit, (lo + hi) / 2) END AS factor FROM it WHERE k = 50")
def _(spark, sf):
    return medians(spark, sf).withColumn("factor", R.bisect_factor(F.col("m"), F.lit(0.1), Stretch()))


@query("estimate_factor", "session:i frame_id:i factor:d", [*fx.F1, SOLVE.format(lo=0.1, hi=100.0, n=20)], "SELECT session, frame_id, (lo + hi) / 2 AS factor FROM it WHERE k = 20")
def _(spark, sf):
    return medians(spark, sf).withColumn("factor", R.estimate_factor(F.col("m"), F.lit(0.1)))


def newton_ctes(source: str, cfg: Stretch) -> list[str]:
    """source: relation (session, frame_id, m, t)."""
    lo, hi, tol = f"{cfg.min_stretch}::DOUBLE", f"{cfg.max_stretch}::DOUBLE", f"{cfg.tolerance}::DOUBLE"
    slope = "(m / sqrt(1.0 + s * m * s * m) * asinh(s) - asinh(s * m) / sqrt(1.0 + s * s)) / (asinh(s) * asinh(s))"
    return [
        f"""nit AS (SELECT session, frame_id, m, t, 0 AS k, least(greatest(t / m, {lo}), {hi}) AS s, false AS done FROM {source}
  UNION ALL
  SELECT session, frame_id, m, t, k + 1, CASE WHEN done OR abs(e) < {tol} THEN s WHEN abs(d) < 1e-8 THEN least(greatest(CASE WHEN e > 0 THEN s * 0.5 ELSE s * 2.0 END, {lo}), {hi}) ELSE least(greatest(s - 0.8::DOUBLE * e / d, {lo}), {hi}) END, done OR abs(e) < {tol}
  FROM (SELECT *, asinh(s * m) / asinh(s) - t AS e, {slope} AS d FROM nit WHERE k < {cfg.max_iterations}))""",
        f"""bit AS (SELECT session, frame_id, m, t, 0 AS k, {lo} AS lo, {hi} AS hi, NULL::DOUBLE AS hit FROM {source}
  UNION ALL
  SELECT session, frame_id, m, t, k + 1, CASE WHEN o < t THEN mid ELSE lo END, CASE WHEN o < t THEN hi ELSE mid END,
    coalesce(hit, CASE WHEN abs(o - t) < {tol} OR ((CASE WHEN o < t THEN hi ELSE mid END) - (CASE WHEN o < t THEN mid ELSE lo END)) / mid < {tol} THEN mid END)
  FROM (SELECT *, (lo + hi) / 2.0::DOUBLE AS mid, asinh((lo + hi) / 2.0::DOUBLE * m) / asinh((lo + hi) / 2.0::DOUBLE) AS o FROM bit WHERE k < {cfg.max_iterations}))""",
        f"""newton AS (SELECT n.session, n.frame_id, CASE WHEN n.m <= 1e-6 THEN 1.0 WHEN n.m >= n.t THEN {lo} WHEN n.done THEN n.s ELSE coalesce(b.hit, (b.lo + b.hi) / 2) END AS factor
  FROM nit n JOIN bit b ON b.session = n.session AND b.frame_id = n.frame_id AND b.k = n.k WHERE n.k = {cfg.max_iterations})""",
    ]


@query(
    "solve_factor_newton",
    "session:i frame_id:i factor:d",
    [*fx.F1, "med AS (SELECT session, frame_id, min(v) / 20.0::DOUBLE + 0.001::DOUBLE AS m, 0.1::DOUBLE AS t FROM pixels GROUP BY session, frame_id)", *newton_ctes("med", Stretch())],
    "SELECT * FROM newton",
)
def _(spark, sf):
    return medians(spark, sf).withColumn("factor", R.newton_factor(Stretch())(F.col("m"), F.lit(0.1)))


def param_ctes(cfg: Stretch) -> list[str]:
    k, t = cfg.black_point_sigma, cfg.target_background
    out = [
        "sig AS (SELECT session, frame_id, avg(sigma) AS sigma FROM rstats GROUP BY session, frame_id)",
        "frac AS (SELECT l.session, l.frame_id, any_value(mode) AS mode, any_value(sigma) AS sigma, avg((v > mode + 2.0::DOUBLE * sigma)::INT::DOUBLE) AS f FROM lum l JOIN bgmode USING (session, frame_id) JOIN sig USING (session, frame_id) GROUP BY l.session, l.frame_id)",
        f"bp AS (SELECT *, greatest(mode - sigma * CASE WHEN f > 0.4 THEN greatest({k}::DOUBLE * 0.6::DOUBLE, 1.5::DOUBLE) WHEN f > 0.2 THEN {k}::DOUBLE * 0.8::DOUBLE ELSE {k}::DOUBLE END, 0.0::DOUBLE) AS raw FROM frac)",
        f"par AS (SELECT session, frame_id, mode, f, CASE WHEN mode - raw < 0.001 THEN 0.0 ELSE raw END AS black_point, greatest(CASE WHEN mode - raw < 0.001 THEN mode ELSE mode - raw END, 1e-6) AS m, CASE WHEN f > 0.4 THEN least({t}::DOUBLE * 1.3::DOUBLE, 0.2::DOUBLE) ELSE {t}::DOUBLE END AS t FROM bp)",
    ]
    if cfg.tone == "mtf":
        out.append("newton AS (SELECT session, frame_id, CASE WHEN abs(2 * t * m - t - m) < 1e-6 THEN 0.5 ELSE least(greatest(m * (t - 1) / (2 * t * m - t - m), 0.0001), 0.9999) END AS factor FROM par)")
    else:
        out += newton_ctes("par", cfg)
    return out


PAR = "SELECT session, frame_id, f AS signal_fraction, black_point, m AS effective_median, t AS target, factor AS strength FROM par JOIN newton USING (session, frame_id)"
PCOLS = "session:i frame_id:i signal_fraction:d black_point:d effective_median:d target:d strength:d"

for label in ("default", "high"):

    @query(f"auto_stretch_parameters_{label}", PCOLS, [*M3, LUM, BGMODE, *param_ctes(STRETCH[label])], PAR)
    def _(spark, sf, label=label):
        return R.stretch_parameters(*fx.mosaic(spark, sf, 3), STRETCH[label])


AUTO = [
    *M3, LUM, BGMODE, *param_ctes(Stretch()),
    "cut AS (SELECT session, frame_id, ch, y, x, greatest(v - black_point, 0.0::DOUBLE) AS v, factor FROM mosaic JOIN par USING (session, frame_id) JOIN newton USING (session, frame_id))",
    RGBW.format(src="cut"),
    f"lums AS (SELECT rgbw.*, {L} AS l, factor AS k FROM rgbw JOIN newton USING (session, frame_id))",
]
SCURVE = "least(greatest({c} + {k}::DOUBLE * ({c} - {m}::DOUBLE) * 4.0::DOUBLE * {c} * (1.0::DOUBLE - {c}), 0.0::DOUBLE), 1.0::DOUBLE)"


@query("auto_stretch_frames", PX, AUTO, coloured("asinh(k * l) / asinh(k)"))
def _(spark, sf):
    return R.auto_stretch(*fx.mosaic(spark, sf, 3))[0]


@query(
    "auto_stretch_per_channel",
    PX,
    [*M3, LUM, BGMODE, *param_ctes(Stretch()), MODES.replace("2.0::DOUBLE * sigma", "2.8::DOUBLE * sigma"),
     "cut AS (SELECT session, frame_id, ch, y, x, greatest(v - black_point, 0.0::DOUBLE) AS v FROM mosaic JOIN bps USING (session, frame_id, ch))",
     RGBW.format(src="cut"), f"lums AS (SELECT rgbw.*, {L} AS l, factor AS k FROM rgbw JOIN newton USING (session, frame_id))"],
    coloured("asinh(k * l) / asinh(k)"),
)
def _(spark, sf):
    return R.auto_stretch(*fx.mosaic(spark, sf, 3), replace(Stretch(), per_channel_black_point=True))[0]


@query("contrast_s_curve", PX, [*fx.F3, RGBW.format(src="rgb"), LUMS], coloured(SCURVE.format(c="least(l, 1.0::DOUBLE)", k=0.8, m=0.2)))
def _(spark, sf):
    return R.contrast_frames(fx.rgb(spark, sf)[0], Contrast())


GAIN = "(1 + CASE WHEN l > 0 AND l < 0.9 THEN 0.5::DOUBLE * (l / 0.5::DOUBLE) * (1 - l / 0.9::DOUBLE) * (1 - l / 0.9::DOUBLE) ELSE 0 END)"


@query("saturation_boost", PX, [*fx.F3, RGBW.format(src="rgb"), LUMS], melt("lums", {c: c01(f"l + ({c} - l) * {GAIN}") for c in "rgb"}))
def _(spark, sf):
    return R.saturate_frames(fx.rgb(spark, sf)[0], Saturation(0.5, 0.5, 0.9))


@query("saturation_custom", PX, [*fx.F3, RGBW.format(src="rgb"), LUMS], melt("lums", {c: c01(f"l + ({c} - l) * 1.5::DOUBLE") for c in "rgb"}))
def _(spark, sf):
    return R.saturate_frames(fx.rgb(spark, sf)[0], boost=lambda lum: F.lit(1.5))


BAYER = "[-8, 0, -6, 2, 4, -4, 6, -2, -5, 3, -7, 1, 7, -1, 5, -3][(y % 4) * 4 + x % 4 + 1]"
CON = SCURVE.format(c="least(l, 1.0::DOUBLE)", k=0.5, m=0.5)


def out8(c: str, gamma: float, dither: bool) -> str:
    v = f"CASE WHEN l > 1e-8 THEN {c01(f'{c} * (({CON}) / l)')} ELSE {c} END"
    q = f"least(greatest(round(pow(least(greatest(round(({v}) * 255.0::DOUBLE), 0), 255) / 255.0::DOUBLE, 1.0::DOUBLE / {gamma}::DOUBLE) * 255.0::DOUBLE), 0), 255)"
    return f"least(greatest({q} + {BAYER}, 0), 255)" if dither else q


for label, dither in (("plain", False), ("dithered", True)):

    @query(
        f"output_8bit_{label}",
        "session:i frame_id:i ch:i y:i x:i u8:i",
        [*fx.F3, RGBW.format(src="rgb"), LUMS],
        melt("lums", {c: out8(c, 2.2, dither) for c in "rgb"}).replace(" AS v FROM", " AS u8 FROM"),
    )
    def _(spark, sf, dither=dither):
        return R.to_output8(fx.rgb(spark, sf)[0], CONTRAST["moderate"], 2.2, dither)
