"""Tile forms over the 48 x 48 mosaics, cut into tiles of 20: nine tiles a frame, those at the edge smaller."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tiles as TL
from ..model import FRAME
from ..operators import debayer as D
from ..operators import lucky as L
from ..operators import warp as W
from . import fixtures as fx
from .q_calibration import PX, VNG_CTE, VNG_VALUES, _pattern, bil, neighbour, rows
from .registry import query

CUT = 20
PATTERNS = "pats AS (SELECT DISTINCT session, frame_id, ['RGGB', 'BGGR', 'GRBG', 'GBRG'][frame_id % 4 + 1] AS pattern FROM mosaic)"


def tiles(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return TL.cut(px, fr, CUT), fr


def demosaic(spark, sf, algorithm):
    t, fr = tiles(spark, sf)
    pattern = fr.select(*FRAME, _pattern().alias("pattern"))
    return TL.melt(D.demosaic_tiles(t, pattern, algorithm, CUT), CUT)


@query("tile_cut", "session:i frame_id:i ch:i ty:i tx:i h:i w:i mean:d", [*fx.F2], f"""SELECT session, frame_id, ch, y // {CUT} AS ty, x // {CUT} AS tx, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w, avg(v) AS mean
   FROM mosaic GROUP BY session, frame_id, ch, y // {CUT}, x // {CUT}""")
def _(spark, sf):
    t, _ = tiles(spark, sf)
    size = t.select(*TL.KEY, "h", "w")
    return TL.melt(t, CUT).groupBy(*FRAME, "ch", F.floor(F.col("y") / CUT).cast("int").alias("ty"), F.floor(F.col("x") / CUT).cast("int").alias("tx")).agg(F.avg("v").alias("mean")).join(size, TL.KEY)


@query("debayer_bilinear_tiles", PX, [*fx.F2, PATTERNS, neighbour("mosaic", 48, 1)], rows(bil(1)))
def _(spark, sf):
    return demosaic(spark, sf, "bilinear")


@query("debayer_gradients_tiles", PX, [*fx.F2, PATTERNS, neighbour("mosaic", 48, 2), VNG_CTE], rows(VNG_VALUES).replace("FROM nc", "FROM ng"))
def _(spark, sf):
    return demosaic(spark, sf, "gradients")


# the neighbours of each interior sample by windows along rows and columns
NEAR = """wx AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS h FROM mosaic WINDOW r AS (PARTITION BY session, frame_id, y ORDER BY x)),
near AS (SELECT *, lag(l) OVER c AS n00, lag(v) OVER c AS n01, lag(h) OVER c AS n02, lead(l) OVER c AS n20, lead(v) OVER c AS n21, lead(h) OVER c AS n22
  FROM wx WINDOW c AS (PARTITION BY session, frame_id, x ORDER BY y)),
grads AS (SELECT session, frame_id, n01 + n21 + l + h - 4.0::DOUBLE * v AS lap,
  pow(n02 - n00 + 2.0::DOUBLE * (h - l) + n22 - n20, 2) + pow(n20 - n00 + 2.0::DOUBLE * (n21 - n01) + n22 - n02, 2) AS g2 FROM near WHERE x BETWEEN 1 AND 46 AND y BETWEEN 1 AND 46)"""


@query(
    "sharpness_tiles",
    "session:i frame_id:i laplacian:d sobel:d tenengrad:d stddev:d",
    [*fx.F2, NEAR],
    """SELECT g.session, g.frame_id, laplacian, sobel, tenengrad, stddev FROM (SELECT session, frame_id, var_pop(lap) AS laplacian, avg(sqrt(g2)) AS sobel, avg(g2) AS tenengrad FROM grads GROUP BY session, frame_id) g
       JOIN (SELECT session, frame_id, stddev_pop(v) AS stddev FROM mosaic GROUP BY session, frame_id) s ON s.session = g.session AND s.frame_id = g.frame_id""",
)
def _(spark, sf):
    t, _ = tiles(spark, sf)
    return L.sharpness_tiles(t, CUT)


def sampled_sql(moves: str, back: str, margin: int) -> list[str]:
    """Bilinear samples at the inverse-mapped points, one equality look-up per corner."""
    corner = " UNION ALL ".join(
        f"SELECT session, frame_id, y, x, floor(sy)::INT + {dy} AS py, floor(sx)::INT + {dx} AS px, (1 - abs(sy - (floor(sy) + {dy}))) * (1 - abs(sx - (floor(sx) + {dx}))) AS k FROM points" for dy in (0, 1) for dx in (0, 1)
    )
    return [
        moves,
        f"""points AS (SELECT * FROM (SELECT m.session, m.frame_id, m.y, m.x, {back} FROM mosaic m JOIN moves t ON t.session = m.session AND t.frame_id = m.frame_id WHERE NOT still)
          WHERE sx >= 0 AND sy >= 0 AND sx < {48 - margin} AND sy < {48 - margin})""",
        f"corner AS ({corner})",
        """moved AS (SELECT c.session, c.frame_id, 0 AS ch, c.y, c.x, sum(k * v) AS v FROM corner c JOIN mosaic m ON m.session = c.session AND m.frame_id = c.frame_id AND m.y = c.py AND m.x = c.px
          GROUP BY c.session, c.frame_id, c.y, c.x)""",
    ]


IDS = "(SELECT DISTINCT session, frame_id FROM mosaic)"
TURNS = f"""moves AS (SELECT *, false AS still FROM (SELECT session, frame_id, ((frame_id % 17) - 8) * 0.05::DOUBLE AS rotation, 1.0::DOUBLE + ((frame_id % 5) - 2) * 0.04::DOUBLE AS scale,
  ((frame_id % 7) - 3) * 3.45::DOUBLE AS tx, ((frame_id % 3) - 1) * 7.6::DOUBLE AS ty FROM {IDS}))"""
BACK = "(cos(rotation) * (m.x - tx) + sin(rotation) * (m.y - ty)) / scale AS sx, (cos(rotation) * (m.y - ty) - sin(rotation) * (m.x - tx)) / scale AS sy"


@query("warp_tiles", PX, [*fx.F2, *sampled_sql(TURNS, BACK, 2)], "SELECT * FROM moved")
def _(spark, sf):
    t, fr = tiles(spark, sf)
    i = F.col("frame_id")
    turns = fr.select(*FRAME, (((i % 17) - 8) * 0.05).alias("rotation"), (1.0 + ((i % 5) - 2) * 0.04).alias("scale"), (((i % 7) - 3) * 3.45).alias("tx"), (((i % 3) - 1) * 7.6).alias("ty"))
    return TL.melt(W.warp_tiles(t, turns, CUT), CUT)


SHIFTS = f"""moves AS (SELECT *, abs(dx) < 0.001 AND abs(dy) < 0.001 AS still FROM (SELECT session, frame_id, CASE WHEN frame_id % 5 = 0 THEN 0.0 ELSE (frame_id % 7 - 3) * 4.25::DOUBLE END AS dx,
  CASE WHEN frame_id % 5 = 0 THEN 0.0 ELSE (frame_id % 3 - 1) * 11.75::DOUBLE END AS dy FROM {IDS}))"""


@query(
    "translate_tiles",
    PX,
    [*fx.F2, *sampled_sql(SHIFTS, "m.x - dx AS sx, m.y - dy AS sy", 1)],
    "SELECT * FROM moved UNION ALL SELECT m.session, m.frame_id, 0, m.y, m.x, m.v FROM mosaic m JOIN moves t ON t.session = m.session AND t.frame_id = m.frame_id WHERE still",
)
def _(spark, sf):
    t, fr = tiles(spark, sf)
    i = F.col("frame_id")
    shifts = fr.select(*FRAME, F.when(i % 5 == 0, 0.0).otherwise((i % 7 - 3) * 4.25).alias("dx"), F.when(i % 5 == 0, 0.0).otherwise((i % 3 - 1) * 11.75).alias("dy"))
    return TL.melt(W.translate_tiles(t, shifts, CUT), CUT)
