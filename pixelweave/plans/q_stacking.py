"""Stacking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import WEIGHTING, Rejection
from ..model import FRAME, PIXEL
from ..operators import calibrate as C
from ..operators import pixels as P
from ..operators import stack as K
from . import fixtures as fx
from .q_calibration import DARK, SITE_KEYS
from .registry import query

STACK = "session:i ch:i y:i x:i w:d mean:d m2:d n:i"
PK = "session, ch, y, x"


def weight_sql(fw: float, sw: float, power: float, lo: float, window: str) -> str:
    def score(c: str, inv: bool) -> str:
        span = f"(max({c}) OVER w - min({c}) OVER w)"
        norm = f"({c} - min({c}) OVER w) / {span}"
        return f"CASE WHEN {c} IS NULL THEN 0.5::DOUBLE WHEN {span} < 1e-10 THEN 1.0::DOUBLE ELSE {'1.0::DOUBLE - ' if inv else ''}{norm} END"

    return f"""weights AS (SELECT session, frame_id, frame_number, greatest(pow({fw}::DOUBLE * ({score('fwhm', True)}) + {sw}::DOUBLE * ({score('snr', False)}), {power}::DOUBLE), {lo}::DOUBLE) AS weight
  FROM quality WINDOW w AS ({window}))"""


RUNNING = "PARTITION BY session ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BALANCED = weight_sql(0.5, 0.5, 1.0, 0.1, RUNNING)


@query("stack_mean", STACK, fx.F1, f"SELECT {PK}, count(*)::DOUBLE AS w, avg(v) AS mean, sum((v - m) * (v - m)) AS m2, count(*) AS n FROM (SELECT *, avg(v) OVER (PARTITION BY {PK}) AS m FROM pixels WHERE abs(v) >= 1e-6) GROUP BY {PK}")
def _(spark, sf):
    return K.stack(fx.pixels(spark, sf))


@query(
    "quality_weights",
    "session:i frame_id:i weight:d",
    [*fx.F4, weight_sql(0.8, 0.2, 1.5, 0.1, RUNNING)],
    "SELECT session, frame_id, weight FROM weights",
)
def _(spark, sf):
    return K.quality_weights(fx.frame_quality(spark, sf), WEIGHTING["galaxies"], block=16)


@query(
    "quality_weights_final",
    "session:i frame_id:i weight:d",
    [*fx.F4, weight_sql(0.2, 0.8, 1.0, 0.1, "PARTITION BY session")],
    "SELECT session, frame_id, weight FROM weights",
)
def _(spark, sf):
    return K.quality_weights(fx.frame_quality(spark, sf), WEIGHTING["nebulae"], final_limits=True)


WSTACK = f"""wpix AS (SELECT p.*, weight FROM pixels p JOIN weights USING (session, frame_id) WHERE abs(v) >= 1e-6),
wmean AS (SELECT {PK}, sum(weight * v) / sum(weight) AS mean FROM wpix GROUP BY {PK}),
wstack AS (SELECT {PK}, sum(weight) AS w, any_value(mean) AS mean, sum(weight * (v - mean) * (v - mean)) AS m2, count(*) AS n FROM wpix JOIN wmean USING ({PK}) GROUP BY {PK})"""


@query("stack_weighted", STACK, [*fx.F4, BALANCED, WSTACK], "SELECT * FROM wstack")
def _(spark, sf):
    return K.stack(fx.pixels(spark, sf), K.quality_weights(fx.frame_quality(spark, sf)))


@query(
    "stack_border",
    STACK,
    fx.F1,
    f"""SELECT {PK}, coalesce(w, 0) AS w, coalesce(mean, 0) AS mean, coalesce(m2, 0) AS m2, coalesce(n, 0) AS n
        FROM (SELECT DISTINCT {PK} FROM pixels) g LEFT JOIN (
          SELECT {PK}, count(*)::DOUBLE AS w, avg(v) AS mean, var_pop(v) * count(*) AS m2, count(*) AS n FROM pixels WHERE abs(v - 1.0) >= 0.5 GROUP BY {PK}) s USING ({PK})""",
)
def _(spark, sf):
    px = fx.pixels(spark, sf)
    kept = K.drop_border(px, 1.0, 0.5)
    return K.fill_empty(K.finish(K.accumulate(kept)), px.select(*PIXEL).distinct())


@query(
    "stack_weighted_coverage",
    STACK + " coverage:d",
    [
        *fx.F1,
        DARK,
        "cal AS (SELECT session, frame_id, frame_number, ch, y, x, greatest(v - dark, 0.0::DOUBLE) AS v FROM pixels JOIN dark USING (ch, y, x) WHERE session > 0)",
        "quality AS (SELECT session, frame_id, frame_number, CASE WHEN frame_id % 7 <> 0 THEN 2.0::DOUBLE + stddev_pop(v) * 10.0::DOUBLE END AS fwhm, max(v) / stddev_pop(v) AS snr FROM cal GROUP BY session, frame_id, frame_number)",
        BALANCED,
        WSTACK.replace("FROM pixels p", "FROM cal p"),
    ],
    "SELECT s.*, n / frames::DOUBLE AS coverage FROM wstack s JOIN (SELECT session, count(*) AS frames FROM weights GROUP BY session) USING (session)",
)
def _(spark, sf):
    px = fx.pixels(spark, sf, carry=("frame_number",))
    dark = C.master_dark(px.filter("session = 0"), SITE_KEYS).withColumn("dark", F.col("dark") * 0.1)
    cal = C.subtract_dark(px.filter("session > 0"), dark)[0]
    g = cal.groupBy(*FRAME, "frame_number").agg(F.stddev_pop("v").alias("s"), F.max("v").alias("m"))
    quality = g.select(
        *FRAME, "frame_number", F.when(F.col("frame_id") % 7 != 0, 2.0 + F.col("s") * 10.0).alias("fwhm"), (F.col("m") / F.col("s")).alias("snr")
    )
    weights = K.quality_weights(quality)
    stacked = K.stack(cal, weights)
    return K.coverage(stacked, weights.groupBy("session").agg(F.count("*").alias("frames")))


def clip_rounds(rounds: int, lo: float, hi: float) -> list[str]:
    out = [f"r0 AS (SELECT {PK}, frame_id, v, weight FROM wpix)"]
    for i in range(rounds):
        out.append(
            f"""r{i + 1} AS (SELECT {PK}, frame_id, v, weight FROM (SELECT *, avg(v) OVER k AS m, stddev_pop(v) OVER k AS s, count(*) OVER k AS c FROM r{i} WINDOW k AS (PARTITION BY {PK}))
            WHERE c < 3 OR (v >= m - {lo}::DOUBLE * s - 1e-12 AND v <= m + {hi}::DOUBLE * s + 1e-12))"""
        )
    return out


UNIT = "weights AS (SELECT session, frame_id, 1.0::DOUBLE AS weight FROM vectors)"
FINISH = f"""SELECT {PK}, sum(weight) AS w, any_value(mean) AS mean, sum(weight * (v - mean) * (v - mean)) AS m2, count(*) AS n
  FROM {{r}} JOIN (SELECT {PK}, sum(weight * v) / sum(weight) AS mean FROM {{r}} GROUP BY {PK}) USING ({PK}) GROUP BY {PK}"""
WPIX = "wpix AS (SELECT p.*, weight FROM pixels p JOIN weights USING (session, frame_id) WHERE abs(v) >= 1e-6)"


@query("reject_sigma_clip", STACK, [*fx.F1, UNIT, WPIX, *clip_rounds(3, 2.0, 2.5)], FINISH.format(r="r3"))
def _(spark, sf):
    return K.rejected_stack(fx.pixels(spark, sf), Rejection("sigma_clip", 2.0, 2.5))


def winsor_rounds(rounds: int, lo: float, hi: float) -> list[str]:
    out = [f"r0 AS (SELECT {PK}, frame_id, v, weight FROM wpix)"]
    for i in range(rounds):
        out.append(
            f"""r{i + 1} AS (SELECT {PK}, frame_id, CASE WHEN c < 3 THEN v ELSE least(greatest(v, m - {lo}::DOUBLE * s), m + {hi}::DOUBLE * s) END AS v, weight
            FROM (SELECT *, avg(v) OVER k AS m, stddev_pop(v) OVER k AS s, count(*) OVER k AS c FROM r{i} WINDOW k AS (PARTITION BY {PK})))"""
        )
    return out


@query("reject_winsorized", STACK, [*fx.F1, UNIT, WPIX, *winsor_rounds(3, 2.0, 2.0)], FINISH.format(r="r3"))
def _(spark, sf):
    return K.rejected_stack(fx.pixels(spark, sf), Rejection("winsorized", 2.0, 2.0))


@query(
    "reject_min_max",
    "session:i ch:i y:i x:i mean:d n:i",
    fx.F1,
    f"SELECT {PK}, (sum(v) - min(v) - max(v)) / (count(*) - 2) AS mean, count(*) AS n FROM pixels WHERE abs(v) >= 1e-6 GROUP BY {PK} HAVING count(*) >= 3",
)
def _(spark, sf):
    return K.min_max_mean(K.drop_border(fx.pixels(spark, sf)))


@query("reject_weighted_sigma_clip", STACK, [*fx.F4, BALANCED, WPIX, *clip_rounds(3, 2.5, 2.5)], FINISH.format(r="r3"))
def _(spark, sf):
    return K.rejected_stack(fx.pixels(spark, sf), Rejection("sigma_clip"), K.quality_weights(fx.frame_quality(spark, sf)))


@query(
    "reject_weighted_min_max",
    STACK,
    [*fx.F4, BALANCED, WPIX, f"r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {PK} ORDER BY v, frame_id) AS r, count(*) OVER (PARTITION BY {PK}) AS c FROM wpix) WHERE c < 3 OR (r > 1 AND r < c))"],
    FINISH.format(r="r1"),
)
def _(spark, sf):
    return K.rejected_stack(fx.pixels(spark, sf), Rejection("min_max"), K.quality_weights(fx.frame_quality(spark, sf)))


@query(
    "reject_custom",
    STACK,
    [*fx.F1, UNIT, WPIX, "r1 AS (SELECT * FROM wpix WHERE v < 0.9)"],
    FINISH.format(r="r1"),
)
def _(spark, sf):
    return K.rejected_stack(fx.pixels(spark, sf), Rejection(), custom=lambda px, keys: px.filter("v < 0.9"))


VERDICT_SRC = """SELECT session, frame_id, frame_number, frame_id % 9 <> 0 AS accepted, (frame_id * 7) % 20 AS stars,
  CASE WHEN frame_number = 1 THEN 'reference' WHEN frame_id % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, (frame_id % 13) / 4.0::DOUBLE AS residual FROM vectors"""
VERDICTS = f"""verdicts AS (SELECT session, frame_id, frame_number, CASE WHEN NOT accepted THEN 0 ELSE stars END AS stars,
  CASE WHEN NOT accepted THEN 'rejected_dimensions' WHEN stars < 5 THEN 'rejected_stars' WHEN status = 'failed' THEN 'rejected_registration' ELSE 'stacked' END AS verdict,
  CASE WHEN accepted AND stars >= 5 AND status = 'ok' THEN residual END AS residual,
  CASE WHEN NOT accepted THEN 'size' WHEN stars < 5 THEN stars || ' stars found, 5 wanted' WHEN status = 'failed' THEN 'not registered: no match' END AS reason
  FROM ({VERDICT_SRC}))"""


def _verdicts(spark, sf):
    fr = fx.frames(spark, sf)
    i = F.col("frame_id")
    checked = fr.select(*FRAME, (i % 9 != 0).alias("accepted"), F.when(i % 9 == 0, "size").alias("reason"))
    stars = fr.select(*FRAME, ((i * 7) % 20).cast("int").alias("stars"))
    reg = fr.select(
        *FRAME,
        F.when(F.col("frame_number") == 1, "reference").when(i % 4 == 0, "failed").otherwise("ok").alias("status"),
        F.lit("no match").alias("reason"),
        ((i % 13) / 4.0).alias("residual"),
    )
    return K.verdicts(fr, checked, stars, reg, 5)


@query("frame_verdicts", "session:i frame_id:i stars:i residual:d verdict:s reason:s", [fx.VECTORS, VERDICTS], "SELECT * FROM verdicts")
def _(spark, sf):
    return _verdicts(spark, sf)


AGGS = """count(*) AS frames_received, sum((verdict = 'stacked')::INT) AS frames_stacked, sum((verdict = 'rejected_stars')::INT) AS rejected_stars,
  sum((verdict = 'rejected_registration')::INT) AS rejected_registration, sum((verdict = 'rejected_dimensions')::INT) AS rejected_dimensions,
  sum(stars) / count(*) AS avg_stars, coalesce(avg(residual), 0) AS avg_residual, 100.0::DOUBLE * sum((verdict = 'stacked')::INT) / count(*) AS success_rate"""
SCOLS = "frames_received:i frames_stacked:i rejected_stars:i rejected_registration:i rejected_dimensions:i avg_stars:d avg_residual:d success_rate:d"


@query("stacking_stats", "session:i " + SCOLS, [fx.VECTORS, VERDICTS], f"SELECT session, {AGGS} FROM verdicts GROUP BY session")
def _(spark, sf):
    return K.stacking_stats(_verdicts(spark, sf))


@query(
    "stacking_stats_rollup",
    "camera:i session:i level:i " + SCOLS,
    [fx.VECTORS, VERDICTS, "v2 AS (SELECT *, session % 3 AS camera FROM verdicts)"],
    f"SELECT camera, session, grouping_id(camera, session) AS level, {AGGS} FROM v2 GROUP BY ROLLUP (camera, session)",
)
def _(spark, sf):
    return K.stacking_stats(_verdicts(spark, sf).withColumn("camera", F.col("session") % 3), ["camera", "session"])


LOG = """log AS (SELECT session, frame_number, frame_id % 6 <> 0 AS stacking, CASE WHEN (frame_number // 10) % 3 = 2 THEN 'comet' ELSE 'deep_sky' END AS stacking_type,
  CASE WHEN (frame_number // 15) % 2 = 1 THEN 4 ELSE 8 END AS width, 8 AS height, frame_id % 8 <> 1 AS registered FROM vectors)"""


def _log(spark, sf):
    fr = fx.frames(spark, sf)
    n, i = F.col("frame_number"), F.col("frame_id")
    return fr.select(
        "session",
        "frame_number",
        (i % 6 != 0).alias("stacking"),
        F.when(F.floor(n / 10) % 3 == 2, "comet").otherwise("deep_sky").alias("stacking_type"),
        F.when(F.floor(n / 15) % 2 == 1, 4).otherwise(8).alias("width"),
        F.lit(8).alias("height"),
        (i % 8 != 1).alias("registered"),
    )


SEG = """SELECT session, frame_number, sum(change::INT) OVER (PARTITION BY session ORDER BY frame_number) AS segment FROM (
  SELECT *, coalesce(stacking AND (NOT coalesce(ps, false) OR stacking_type <> pt), false) OR coalesce(width <> pw OR height <> ph, false){extra} AS change FROM (
    SELECT *, lag(stacking) OVER w AS ps, lag(stacking_type) OVER w AS pt, lag(width) OVER w AS pw, lag(height) OVER w AS ph, lag(registered) OVER w AS pr
    FROM log WINDOW w AS (PARTITION BY session ORDER BY frame_number)))"""


@query("stack_segments", "session:i frame_number:i segment:i", [fx.VECTORS, LOG], SEG.format(extra=""))
def _(spark, sf):
    return K.segments(_log(spark, sf), block=8)


@query("stack_segments_wanderer", "session:i frame_number:i segment:i", [fx.VECTORS, LOG], SEG.format(extra=" OR coalesce(ps AND NOT pr, false)"))
def _(spark, sf):
    return K.segments(_log(spark, sf), wanderer=True, block=8)


@query(
    "stack_by_segment",
    "session:i segment:i ch:i y:i x:i mean:d n:i",
    [*fx.F1, LOG, "seg AS (" + SEG.format(extra="") + ")"],
    "SELECT session, segment, ch, y, x, avg(v) AS mean, count(*) AS n FROM pixels JOIN seg USING (session, frame_number) WHERE abs(v) >= 1e-6 GROUP BY session, segment, ch, y, x",
)
def _(spark, sf):
    seg = K.segments(_log(spark, sf), block=8).select("session", "frame_number", "segment")
    px = fx.pixels(spark, sf, carry=("frame_number",)).join(seg, ["session", "frame_number"])
    return K.stack(px, keys=["session", "segment", "ch", "y", "x"])
