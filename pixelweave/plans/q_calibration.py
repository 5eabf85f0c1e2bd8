"""Calibration and debayer queries: session 0 is the dark series, session 1 the flat series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import cfa_colour
from ..operators import calibrate as C
from ..operators import debayer as D
from . import fixtures as fx
from .registry import query

PX = "session:i frame_id:i ch:i y:i x:i v:d"
SITE_KEYS = ["ch", "y", "x"]

DARK = "dark AS (SELECT ch, y, x, avg(v) * 0.1::DOUBLE AS dark FROM pixels WHERE session = 0 GROUP BY ch, y, x)"
FLAT = """flat_mean AS (SELECT ch, y, x, avg(v) AS m FROM pixels WHERE session = 1 GROUP BY ch, y, x),
flat AS (SELECT ch, y, x, greatest(m / (SELECT avg(m) FROM flat_mean), 0.01::DOUBLE) AS flat FROM flat_mean)"""


def masters(px):
    dark = C.master_dark(px.filter("session = 0"), SITE_KEYS).withColumn("dark", F.col("dark") * 0.1)
    flat = C.master_flat(px.filter("session = 1"), SITE_KEYS)
    return dark, flat


@query("master_dark", "session:i ch:i y:i x:i dark:d", fx.F1, "SELECT session, ch, y, x, avg(v) AS dark FROM pixels GROUP BY session, ch, y, x")
def _(spark, sf):
    return C.master_dark(fx.pixels(spark, sf))


@query(
    "master_flat",
    "session:i ch:i y:i x:i flat:d",
    [*fx.F1, "m AS (SELECT session, ch, y, x, avg(v) AS m FROM pixels GROUP BY session, ch, y, x)"],
    "SELECT session, ch, y, x, greatest(m / avg(m) OVER (PARTITION BY session), 0.01::DOUBLE) AS flat FROM m",
)
def _(spark, sf):
    return C.master_flat(fx.pixels(spark, sf))


@query(
    "dark_subtract",
    PX,
    [*fx.F1, DARK],
    "SELECT session, frame_id, ch, y, x, greatest(v - dark, 0.0::DOUBLE) AS v FROM pixels JOIN dark USING (ch, y, x) WHERE session > 1",
)
def _(spark, sf):
    px = fx.pixels(spark, sf)
    return C.subtract_dark(px.filter("session > 1"), masters(px)[0])[0]


@query(
    "flat_divide",
    PX,
    [*fx.F1, FLAT],
    "SELECT session, frame_id, ch, y, x, v / flat AS v FROM pixels JOIN flat USING (ch, y, x) WHERE session > 1",
)
def _(spark, sf):
    px = fx.pixels(spark, sf)
    return C.divide_flat(px.filter("session > 1"), masters(px)[1])[0]


@query(
    "calibrate",
    PX,
    [*fx.F1, DARK, FLAT],
    "SELECT session, frame_id, ch, y, x, greatest(v - dark, 0.0::DOUBLE) / flat AS v FROM pixels JOIN dark USING (ch, y, x) JOIN flat USING (ch, y, x) WHERE session > 1",
)
def _(spark, sf):
    px = fx.pixels(spark, sf)
    return C.calibrate(px.filter("session > 1"), *masters(px))[0]


# a dark without its last row, and every third frame cut to six rows: only those are covered
SHORT = "part AS (SELECT * FROM pixels WHERE session > 1 AND (frame_id % 3 <> 0 OR y < 6)), short AS (SELECT * FROM dark WHERE y < 7)"


def short_master(spark, sf):
    px = fx.pixels(spark, sf)
    dark, flat = masters(px)
    part = px.filter("session > 1 AND (frame_id % 3 <> 0 OR y < 6)")
    return C.calibrate(part, dark.filter("y < 7"), flat)


@query(
    "calibrate_short_master",
    PX,
    [*fx.F1, DARK, FLAT, SHORT],
    "SELECT session, frame_id, ch, y, x, greatest(v - dark, 0.0::DOUBLE) / flat AS v FROM part JOIN short USING (ch, y, x) JOIN flat USING (ch, y, x) WHERE frame_id % 3 = 0",
)
def _(spark, sf):
    return short_master(spark, sf)[0]


@query(
    "calibrate_rejects",
    "session:i frame_id:i missing:i reason:s",
    [*fx.F1, DARK, SHORT],
    "SELECT session, frame_id, count(*) AS missing, 'samples outside a calibration master' AS reason FROM part ANTI JOIN short USING (ch, y, x) GROUP BY session, frame_id",
)
def _(spark, sf):
    return short_master(spark, sf)[1]


# ---- debayer ---------------------------------------------------------------------

COLOUR = """CASE pattern WHEN 'RGGB' THEN [0,1,1,2] WHEN 'BGGR' THEN [2,1,1,0] WHEN 'GRBG' THEN [1,0,2,1] ELSE [1,2,0,1] END[(({y}) & 1) * 2 + (({x}) & 1) + 1]"""
PATTERNS = "pats AS (SELECT session, frame_id, ['RGGB', 'BGGR', 'GRBG', 'GBRG'][frame_id % 4 + 1] AS pattern FROM vectors)"


@query(
    "cfa_colour",
    "session:i frame_id:i y:i x:i colour:i",
    [*fx.F1, PATTERNS],
    f"SELECT session, frame_id, y, x, {COLOUR.format(y='y', x='x')} AS colour FROM pixels JOIN pats USING (session, frame_id)",
)
def _(spark, sf):
    px = fx.pixels(spark, sf).withColumn("pattern", _pattern())
    return px.withColumn("colour", cfa_colour(F.col("x"), F.col("y"), F.col("pattern")))


def _pattern():
    return F.element_at(F.array(*[F.lit(p) for p in ("RGGB", "BGGR", "GRBG", "GBRG")]), (F.col("frame_id") % 4 + 1).cast("int"))


DETECT = """grid AS (SELECT session, frame_id, avg(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v END) AS m00, avg(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v END) AS m01,
  avg(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v END) AS m10, avg(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v END) AS m11 FROM {src} GROUP BY session, frame_id),
diag AS (SELECT *, abs(m00 - m11) AS d1, abs(m01 - m10) AS d2, abs(m00 - m11) < abs(m01 - m10) AS g FROM grid),
found AS (SELECT session, frame_id, m00, m01, m10, m11, CASE WHEN g AND m01 > m10 THEN 'GRBG' WHEN g THEN 'GBRG' WHEN m00 > m11 THEN 'RGGB' ELSE 'BGGR' END AS pattern,
  least(greatest(0.6::DOUBLE * CASE WHEN greatest(d1, d2) > 0.001 THEN 1 - least(least(d1, d2) / greatest(d1, d2), 1) ELSE 0.5 END
    + 0.4::DOUBLE * CASE WHEN greatest(m00, m01, m10, m11) > 0.001 THEN least((CASE WHEN g THEN d2 ELSE d1 END) / greatest(m00, m01, m10, m11), 1) ELSE 0 END, 0), 1) AS confidence FROM diag)"""


@query("cfa_detect", "session:i frame_id:i pattern:s confidence:d m00:d m01:d m10:d m11:d", [*fx.F1, DETECT.format(src="pixels")], "SELECT * FROM found")
def _(spark, sf):
    return D.detect_pattern(fx.pixels(spark, sf), fx.frames(spark, sf))


def neighbour(src: str, side: int, radius: int) -> str:
    r = range(-radius, radius + 1)
    picks = ", ".join(
        f"max(CASE WHEN o.dy = {dy} AND o.dx = {dx} THEN b.v END) AS n{dy + radius}{dx + radius}" for dy in r for dx in r
    )
    return f"""off AS (SELECT dy.d AS dy, dx.d AS dx FROM range(-{radius}, {radius + 1}) dy(d), range(-{radius}, {radius + 1}) dx(d)),
nb AS (SELECT a.session, a.frame_id, a.y, a.x, {picks} FROM {src} a CROSS JOIN off o JOIN {src} b ON b.session = a.session AND b.frame_id = a.frame_id
  AND b.y = least(greatest(a.y + o.dy, 0), {side - 1}) AND b.x = least(greatest(a.x + o.dx, 0), {side - 1}) GROUP BY a.session, a.frame_id, a.y, a.x),
nc AS (SELECT nb.*, pattern, {COLOUR.format(y='y', x='x')} AS own, {COLOUR.format(y='y', x='x + 1')} AS side FROM nb JOIN pats USING (session, frame_id))"""


def bil(radius: int) -> dict[int, str]:
    n = lambda dy, dx: f"n{dy + radius}{dx + radius}"
    row, col = f"({n(0, -1)} + {n(0, 1)}) / 2", f"({n(-1, 0)} + {n(1, 0)}) / 2"
    cross = f"({n(0, -1)} + {n(0, 1)} + {n(-1, 0)} + {n(1, 0)}) / 4"
    corner = f"({n(-1, -1)} + {n(-1, 1)} + {n(1, -1)} + {n(1, 1)}) / 4"
    one = lambda c: f"CASE WHEN own = {c} THEN {n(0, 0)} WHEN own = 1 THEN CASE WHEN side = {c} THEN {row} ELSE {col} END ELSE {corner} END"
    return {0: one(0), 1: f"CASE WHEN own = 1 THEN {n(0, 0)} ELSE {cross} END", 2: one(2)}


def rows(values: dict[int, str]) -> str:
    return " UNION ALL ".join(f"SELECT session, frame_id, {c} AS ch, y, x, {v} AS v FROM nc" for c, v in values.items())


@query("debayer_bilinear", PX, [*fx.F1, PATTERNS, neighbour("pixels", 8, 1)], rows(bil(1)))
def _(spark, sf):
    px = fx.pixels(spark, sf)
    return D.bilinear(px, fx.frames(spark, sf).select("session", "frame_id", _pattern().alias("pattern")))


@query(
    "debayer_auto",
    PX,
    [*fx.F2, DETECT.format(src="mosaic"), "pats AS (SELECT session, frame_id, pattern FROM found)", neighbour("mosaic", 48, 1)],
    rows(bil(1)),
)
def _(spark, sf):
    return D.auto(*fx.mosaic(spark, sf))


COMPASS = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def gradient_sql() -> tuple[str, dict[int, str]]:
    n = lambda dy, dx: f"n{dy + 2}{dx + 2}"
    g = [f"abs({n(2 * dy, 2 * dx)} - n22) + abs({n(dy, dx)} - {n(-dy, -dx)})" for dx, dy in COMPASS]
    cte = "nd AS (SELECT *, " + ", ".join(f"{e} AS g{i}" for i, e in enumerate(g)) + " FROM nc)"
    gs = ", ".join(f"g{i}" for i in range(8))
    cte += f", ng AS (SELECT *, (least({gs}) + greatest({gs})) / 2 AS lim FROM nd)"
    count = " + ".join(f"(g{i} <= lim + 1e-15)::INT" for i in range(8))
    plain, values = bil(2), {}
    for c in (0, 1, 2):
        total = " + ".join(
            f"CASE WHEN g{i} <= lim + 1e-15 AND {COLOUR.format(y=f'y + ({dy})', x=f'x + ({dx})')} = {c} THEN {n(dy, dx)} ELSE 0 END" for i, (dx, dy) in enumerate(COMPASS)
        )
        values[c] = f"CASE WHEN own = {c} THEN n22 WHEN {total} > 0 THEN ({total}) / ({count}) ELSE {plain[c]} END"
    return cte, values


VNG_CTE, VNG_VALUES = gradient_sql()


@query("debayer_gradients", PX, [*fx.F1, PATTERNS, neighbour("pixels", 8, 2), VNG_CTE], rows(VNG_VALUES).replace("FROM nc", "FROM ng"))
def _(spark, sf):
    px = fx.pixels(spark, sf)
    return D.variable_gradients(px, fx.frames(spark, sf).select("session", "frame_id", _pattern().alias("pattern")))
