"""Background queries on 48x48 mosaics with a 5 x 6 node grid."""

from __future__ import annotations

from dataclasses import replace

from ..config import Background
from ..model import FRAME
from ..operators import background as B
from . import fixtures as fx
from .q_statistics import clip_ctes
from .registry import query

CFG = Background(cols=6, rows=5, aggressiveness=0.8)
NODES = "nodes AS (SELECT f.session, f.frame_id, r.r AS row, c.c AS col, (c.c * 47) // 5 AS nx, (r.r * 47) // 4 AS ny FROM (SELECT DISTINCT session, frame_id FROM mosaic) f, range(0, 5) r(r), range(0, 6) c(c))"
BOX = "box AS (SELECT session, frame_id, ch, row, col, v FROM nodes JOIN mosaic USING (session, frame_id) WHERE abs(x - nx) <= 4 AND abs(y - ny) <= 4)"
KEYS = "session, frame_id, ch, row, col"
VALUES = [NODES, BOX, *clip_ctes("box", KEYS, 3.0, 3), f"vals AS (SELECT {KEYS}, median(v) AS value FROM clip3 GROUP BY {KEYS})"]
PRUNE = [
    "gm AS (SELECT session, frame_id, median(value) AS m FROM vals WHERE ch = 1 GROUP BY session, frame_id)",
    "gl AS (SELECT v.session, v.frame_id, any_value(m) + 2.5::DOUBLE * 1.4826::DOUBLE * median(abs(value - m)) AS lim FROM vals v JOIN gm USING (session, frame_id) WHERE ch = 1 GROUP BY v.session, v.frame_id)",
    "s1 AS (SELECT session, frame_id, row, col, value FROM vals JOIN gl USING (session, frame_id) WHERE ch = 1 AND value <= lim)",
    """s2 AS (SELECT a.session, a.frame_id, a.row, a.col, a.value FROM s1 a LEFT JOIN s1 b ON b.session = a.session AND b.frame_id = a.frame_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)
      GROUP BY a.session, a.frame_id, a.row, a.col, a.value HAVING median(b.value) IS NULL OR a.value <= median(b.value) * 1.05::DOUBLE)""",
]
SIDES = "list_filter([CASE WHEN i // 6 > 0 THEN g[i - 6 + 1] END, CASE WHEN i // 6 < 4 THEN g[i + 6 + 1] END, CASE WHEN i % 6 > 0 THEN g[i - 1 + 1] END, CASE WHEN i % 6 < 5 THEN g[i + 1 + 1] END], lambda q: q IS NOT NULL)"
MODEL = [
    *VALUES,
    *PRUNE,
    "ok AS (SELECT session, frame_id, count(*) AS n, median(value) AS m FROM s2 GROUP BY session, frame_id)",
    """start AS (SELECT v.session, v.frame_id, v.ch, list(CASE WHEN s2.value IS NOT NULL THEN v.value END ORDER BY v.row, v.col) AS g FROM vals v LEFT JOIN s2 USING (session, frame_id, row, col) GROUP BY v.session, v.frame_id, v.ch)""",
    f"""paint AS (SELECT session, frame_id, ch, 0 AS k, g FROM start UNION ALL
      SELECT session, frame_id, ch, k + 1, list_transform(range(0, 30), lambda i: coalesce(g[i + 1], list_avg({SIDES}))) FROM paint WHERE k < 11)""",
    "model AS (SELECT p.session, p.frame_id, p.ch, CASE WHEN coalesce(ok.n, 0) < 4 THEN list_transform(range(0, 30), lambda i: coalesce(ok.m, 0)) ELSE list_transform(g, lambda q: coalesce(q, 0)) END AS g FROM paint p LEFT JOIN ok USING (session, frame_id) WHERE k = 11)",
]


def parts(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return px, fr, B.node_values(px, fr, CFG)


@query("background_node_grid", "session:i frame_id:i row:i col:i nx:i ny:i box:i", [*fx.F3M, NODES], "SELECT *, 9 AS box FROM nodes")
def _(spark, sf):
    return B.node_grid(fx.mosaic(spark, sf, 3)[1], CFG)


@query("background_node_values", "session:i frame_id:i ch:i row:i col:i value:d", [*fx.F3M, *VALUES], "SELECT * FROM vals")
def _(spark, sf):
    return parts(spark, sf)[2]


@query("background_pruned_nodes", "session:i frame_id:i row:i col:i value:d", [*fx.F3M, *VALUES, *PRUNE], "SELECT * FROM s2")
def _(spark, sf):
    _, fr, nodes = parts(spark, sf)
    return B.pruned_nodes(nodes, fr, CFG)


@query(
    "background_model",
    "session:i frame_id:i ch:i row:i col:i nx:i ny:i value:d",
    [*fx.F3M, *MODEL],
    "SELECT session, frame_id, ch, i // 6 AS row, i % 6 AS col, ((i % 6) * 47) // 5 AS nx, ((i // 6) * 47) // 4 AS ny, g[i + 1] AS value FROM model, range(0, 30) t(i)",
)
def _(spark, sf):
    _, fr, nodes = parts(spark, sf)
    return B.model_nodes(B.build_model(nodes, fr, CFG), CFG)


# four nodes per frame: a pruned node leaves fewer than four, and the model turns flat
TWO = Background(cols=2, rows=2)
TWO_NODES = "nodes AS (SELECT f.session, f.frame_id, r.r AS row, c.c AS col, c.c * 47 AS nx, r.r * 47 AS ny FROM (SELECT DISTINCT session, frame_id FROM mosaic) f, range(0, 2) r(r), range(0, 2) c(c))"


@query(
    "background_flat_fallback",
    "session:i frame_id:i ch:i row:i col:i value:d valid_nodes:i",
    [*fx.F3M, TWO_NODES, *VALUES[1:], *PRUNE, "ok AS (SELECT session, frame_id, count(*) AS n, median(value) AS m FROM s2 GROUP BY session, frame_id)"],
    "SELECT v.session, v.frame_id, v.ch, v.row, v.col, CASE WHEN coalesce(n, 0) < 4 THEN coalesce(m, 0) ELSE v.value END AS value, coalesce(n, 0) AS valid_nodes FROM vals v LEFT JOIN ok USING (session, frame_id)",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    model = B.build_model(B.node_values(px, fr, TWO), fr, TWO)
    return B.model_nodes(model, TWO).join(model.select(*FRAME, "valid_nodes"), FRAME)


CELL = "least(CASE WHEN (({p} * {n} // 47 + 1) * 47) // {n} <= {p} THEN {p} * {n} // 47 + 1 ELSE {p} * {n} // 47 END, {n} - 1)"
EVAL = f"""cells AS (SELECT session, frame_id, ch, y, x, v, {CELL.format(p='x', n=5)} AS cx, {CELL.format(p='y', n=4)} AS cy FROM mosaic),
lerp AS (SELECT c.*, g, (x - (cx * 47) // 5) / (((cx + 1) * 47) // 5 - (cx * 47) // 5)::DOUBLE AS fx, (y - (cy * 47) // 4) / (((cy + 1) * 47) // 4 - (cy * 47) // 4)::DOUBLE AS fy FROM cells c JOIN model USING (session, frame_id, ch)),
bgv AS (SELECT session, frame_id, ch, y, x, v, (g[cy*6+cx+1] * (1 - fx) + g[cy*6+cx+2] * fx) * (1 - fy) + (g[(cy+1)*6+cx+1] * (1 - fx) + g[(cy+1)*6+cx+2] * fx) * fy AS bg FROM lerp)"""


@query("background_evaluate", "session:i frame_id:i ch:i y:i x:i bg:d", [*fx.F3M, *MODEL, EVAL], "SELECT * FROM bgv")
def _(spark, sf):
    px, fr, nodes = parts(spark, sf)
    return B.evaluate(px, B.build_model(nodes, fr, CFG), CFG)


@query(
    "background_evaluate_centre",
    "session:i frame_id:i ch:i y:i x:i bg:d",
    [*fx.F3M, *MODEL,
     "gc AS (SELECT session, frame_id, ch, y, x, g, (x + 0.5::DOUBLE) * 6 / 48 - 0.5::DOUBLE AS gx, (y + 0.5::DOUBLE) * 5 / 48 - 0.5::DOUBLE AS gy FROM mosaic JOIN model USING (session, frame_id, ch))",
     "gd AS (SELECT *, least(greatest(floor(gx), 0), 5)::INT AS x0, least(greatest(floor(gy), 0), 4)::INT AS y0 FROM gc)",
     "ge AS (SELECT *, least(x0 + 1, 5) AS x1, least(y0 + 1, 4) AS y1, least(greatest(gx - x0, 0), 1) AS fx, least(greatest(gy - y0, 0), 1) AS fy FROM gd)"],
    "SELECT session, frame_id, ch, y, x, (g[y0*6+x0+1] * (1 - fx) + g[y0*6+x1+1] * fx) * (1 - fy) + (g[y1*6+x0+1] * (1 - fx) + g[y1*6+x1+1] * fx) * fy AS bg FROM ge",
)
def _(spark, sf):
    px, fr, nodes = parts(spark, sf)
    return B.evaluate(px, B.build_model(nodes, fr, CFG), CFG, mode="centre")


REF = "refs AS (SELECT session, frame_id, ch, list_sort(g)[floor(29 * 0.1::DOUBLE)::INT + 1] AS ref FROM model)"


@query(
    "background_subtract",
    "session:i frame_id:i ch:i y:i x:i v:d",
    [*fx.F3M, *MODEL, EVAL, REF],
    "SELECT session, frame_id, ch, y, x, greatest(v - 0.8::DOUBLE * (bg - ref), 0) AS v FROM bgv JOIN refs USING (session, frame_id, ch)",
)
def _(spark, sf):
    px, fr, nodes = parts(spark, sf)
    return B.subtract(px, B.build_model(nodes, fr, CFG), CFG)


@query(
    "background_subtract_full",
    "session:i frame_id:i ch:i y:i x:i v:d",
    [*fx.F3M, *MODEL, EVAL],
    "SELECT session, frame_id, ch, y, x, greatest(v - 0.8::DOUBLE * bg, 0) AS v FROM bgv",
)
def _(spark, sf):
    px, fr, nodes = parts(spark, sf)
    cfg = replace(CFG, gradient_only=False)
    return B.subtract(px, B.build_model(nodes, fr, cfg), cfg)


@query(
    "background_auto_aggressiveness",
    "session:i frame_id:i aggressiveness:d",
    [*fx.F3M, *MODEL, "cv AS (SELECT session, frame_id, avg(q) AS m, stddev_pop(q) / avg(q) AS cv FROM (SELECT session, frame_id, unnest(g) AS q FROM model WHERE ch = 1) GROUP BY session, frame_id)"],
    "SELECT session, frame_id, CASE WHEN m < 1e-9 THEN 0.5 WHEN cv < 0.03 THEN 0.7 WHEN cv > 0.15 THEN 0.15 ELSE 0.7::DOUBLE - (cv - 0.03::DOUBLE) / 0.12::DOUBLE * 0.55::DOUBLE END AS aggressiveness FROM cv",
)
def _(spark, sf):
    _, fr, nodes = parts(spark, sf)
    return B.subtraction_levels(B.build_model(nodes, fr, CFG), replace(CFG, aggressiveness=-1.0)).select(*FRAME, "aggressiveness")


BLOCK = "blk AS (SELECT session, frame_id, ch, least(y // 9, 4) AS row, least(x // 8, 5) AS col, v FROM mosaic)"


@query(
    "background_block_medians",
    "session:i frame_id:i ch:i row:i col:i clipped_median:d kept:i",
    [*fx.F3M, BLOCK, *[c.replace("mad < 1e-9 OR ", "") for c in clip_ctes("blk", KEYS, 2.5, 1)]],
    f"SELECT {KEYS}, median(v) AS clipped_median, count(*) AS kept FROM clip1 GROUP BY {KEYS}",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return B.block_medians(px, fr, 5, 6)
