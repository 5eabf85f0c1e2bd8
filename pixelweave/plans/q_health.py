"""Health queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health as H
from . import fixtures as fx
from .registry import query

HOUR = 3_600_000_000
CAM = "PARTITION BY camera ORDER BY t_us, event_id"


@query(
    "event_log_parse",
    "camera:i event_id:i kind:s k:i has_frame:b",
    fx.F5,
    "SELECT camera, event_id, kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.frame_number') IS NOT NULL AS has_frame FROM cam",
)
def _(spark, sf):
    return H.parse_events(fx.camera_events(spark, sf)).withColumn("has_frame", F.col("frame_number").isNotNull())


@query(
    "rejection_bursts",
    "camera:i event_id:i t_us:i recent:i alert:b stop:b",
    fx.F5,
    f"""SELECT camera, event_id, t_us, recent, recent >= 5 AS alert, recent >= 5 AND stk = 0 AS stop FROM (
      SELECT *, sum((kind = 'rejected')::INT) OVER (PARTITION BY camera ORDER BY t_us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS recent,
        sum((kind = 'captured')::INT) OVER ({CAM}) AS stk FROM cam WHERE kind IN ('rejected', 'captured')) WHERE kind = 'rejected'""",
)
def _(spark, sf):
    return H.rejection_bursts(fx.camera_events(spark, sf), 6 * HOUR, 5)


STREAK = f"""st AS (SELECT *, sum((kind <> 'timeout')::INT) OVER ({CAM}) AS grp FROM cam WHERE kind <> 'rejected'),
stn AS (SELECT camera, t_us, event_id, kind, count(*) FILTER (kind = 'timeout') OVER (PARTITION BY camera, grp ORDER BY t_us, event_id) AS streak FROM st)"""


@query("timeout_streaks", "camera:i event_id:i streak:i unresponsive:b", [*fx.F5, STREAK], "SELECT *, streak >= 3 AS unresponsive FROM stn WHERE kind = 'timeout'")
def _(spark, sf):
    return H.timeout_streaks(fx.camera_events(spark, sf))


@query(
    "session_counters",
    "camera:i event_id:i captured:i rejected:i stacked:i",
    fx.F5,
    f"SELECT camera, event_id, c AS captured, r AS rejected, greatest(c - r, 0) AS stacked FROM (SELECT *, sum((kind = 'captured')::INT) OVER ({CAM}) AS c, sum((kind = 'rejected')::INT) OVER ({CAM}) AS r FROM cam)",
)
def _(spark, sf):
    return H.session_counters(fx.camera_events(spark, sf))


@query(
    "latest_only",
    "camera:i kind:s t_us:i event_id:i value:d skipped:i",
    fx.F5,
    "SELECT camera, kind, max(t_us) AS t_us, arg_max(event_id, (t_us, event_id)) AS event_id, arg_max(value, (t_us, event_id)) AS value, count(*) - 1 AS skipped FROM cam GROUP BY camera, kind",
)
def _(spark, sf):
    return H.latest_only(fx.camera_events(spark, sf), ["camera", "kind"], ["t_us", "event_id"], ["value"])


@query(
    "dropped_frames",
    "session:i frame_number:i dropped:i",
    fx.F5,
    "SELECT * FROM (SELECT camera AS session, event_id AS frame_number, event_id - lag(event_id) OVER (PARTITION BY camera ORDER BY event_id) - 1 AS dropped FROM cam) WHERE dropped > 0",
)
def _(spark, sf):
    e = fx.camera_events(spark, sf).select(F.col("camera").alias("session"), F.col("event_id").alias("frame_number"))
    return H.dropped_frames(e, block=512)


DEPTH = "depth AS (SELECT camera, t_us, event_id, floor(value)::BIGINT % 11 AS queue_depth FROM cam)"
TRANS = f"trans AS (SELECT *, queue_depth > 5 AS o, coalesce(lag(queue_depth) OVER ({CAM}) > 5, false) AS w FROM depth)"


def depths(spark, sf):
    return fx.camera_events(spark, sf).withColumn("queue_depth", F.floor("value") % 11)


@query("queue_transitions", "camera:i event_id:i queue_depth:i event:s", [*fx.F5, DEPTH, TRANS], "SELECT *, CASE WHEN o THEN 'warning' ELSE 'cleared' END AS event FROM trans WHERE o <> w")
def _(spark, sf):
    return H.queue_transitions(depths(spark, sf))


@query(
    "queue_alerts",
    "camera:i event_id:i queue_depth:i event:s",
    [
        *fx.F5,
        DEPTH,
        TRANS,
        f"numd AS (SELECT *, row_number() OVER ({CAM}) AS k FROM trans)",
        f"""walk AS (SELECT camera, k, event_id, queue_depth, o, w, CASE WHEN o THEN t_us END AS last, CASE WHEN o THEN 'warning' END AS event FROM numd WHERE k = 1
          UNION ALL
          SELECT n.camera, n.k, n.event_id, n.queue_depth, n.o, n.w, CASE WHEN NOT n.o THEN NULL WHEN NOT n.w OR n.t_us - walk.last >= {HOUR // 6} THEN n.t_us ELSE walk.last END,
            CASE WHEN n.o AND NOT n.w THEN 'warning' WHEN n.o AND n.t_us - walk.last >= {HOUR // 6} THEN 'repeated' WHEN n.w AND NOT n.o THEN 'cleared' END
          FROM walk JOIN numd n ON n.camera = walk.camera AND n.k = walk.k + 1)""",
    ],
    "SELECT camera, event_id, queue_depth, event FROM walk WHERE event IS NOT NULL",
)
def _(spark, sf):
    return H.queue_alerts(depths(spark, sf), 5, HOUR // 6)


STAGES = ("capture", "debayer", "stack", "render", "encode", "poll", "storage", "solve")


@query(
    "stage_latency",
    "stage:s window_us:i samples:i mean:d p50:d p95:d p99:d worst:d",
    fx.F5,
    f"""SELECT stage, (t_us // {24 * HOUR}) * {24 * HOUR} AS window_us, count(*) AS samples, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS worst
        FROM (SELECT *, {list(STAGES)}[event_id % 8 + 1] AS stage FROM cam) GROUP BY stage, t_us // {24 * HOUR}""",
)
def _(spark, sf):
    names = F.array(*[F.lit(s) for s in STAGES])
    e = fx.camera_events(spark, sf).withColumn("stage", F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")))
    return H.stage_latency(e, "1 day")


@query(
    "frame_rates",
    "camera:i window_us:i published:i dropped:i skipped:i rate:d",
    fx.F5,
    f"SELECT camera, (t_us // {HOUR}) * {HOUR} AS window_us, count(*) FILTER (kind = 'captured') AS published, count(*) FILTER (kind = 'rejected') AS dropped, count(*) FILTER (kind = 'timeout') AS skipped, count(*) FILTER (kind = 'captured') / 3600.0::DOUBLE AS rate FROM cam GROUP BY camera, t_us // {HOUR}",
)
def _(spark, sf):
    return H.frame_rates(fx.camera_events(spark, sf))


@query(
    "status_samples",
    "camera:i window_us:i value:d polls:i",
    fx.F5,
    f"SELECT camera, (t_us // {HOUR // 2}) * {HOUR // 2} AS window_us, arg_max(value, (t_us, event_id)) AS value, count(*) AS polls FROM cam WHERE kind = 'status' GROUP BY camera, t_us // {HOUR // 2}",
)
def _(spark, sf):
    return H.status_samples(fx.camera_events(spark, sf), "30 minutes")


@query(
    "slow_captures",
    "event_id:i exposure_s:d duration_s:d limit_s:d",
    fx.F5,
    """SELECT * FROM (SELECT event_id, exposure_s, duration_s, exposure_s + CASE WHEN exposure_s >= 30 THEN 40.0::DOUBLE ELSE 5.0::DOUBLE + 35.0::DOUBLE * (exposure_s / 30.0::DOUBLE) END AS limit_s
       FROM (SELECT event_id, (event_id % 45)::DOUBLE AS exposure_s, value AS duration_s FROM cam)) WHERE duration_s > limit_s""",
)
def _(spark, sf):
    e = fx.camera_events(spark, sf).select("event_id", (F.col("event_id") % 45).cast("double").alias("exposure_s"), F.col("value").alias("duration_s"))
    return H.slow_captures(e, 30.0)


EDGE = "req AS (SELECT client, CASE WHEN event_id % 10 <> 0 THEN 600 + (event_id * 37) % 4000 END AS width, CASE WHEN event_id % 7 <> 0 THEN 500 + (event_id * 53) % 3000 END AS height FROM cam)"


@query(
    "tier_demand",
    "tier:s requests:i clients:i",
    [*fx.F5, EDGE],
    """SELECT CASE WHEN e <= 1080 THEN 'hd1080' WHEN e <= 1440 THEN 'qhd1440' WHEN e <= 2160 THEN 'uhd2160' ELSE 'original' END AS tier, count(*) AS requests, count(DISTINCT client) AS clients
       FROM (SELECT client, CASE WHEN width IS NULL AND height IS NULL THEN 1080 ELSE least(coalesce(width, height), coalesce(height, width)) END AS e FROM req) GROUP BY 1""",
)
def _(spark, sf):
    i = F.col("event_id")
    e = fx.camera_events(spark, sf).select(
        "client", F.when(i % 10 != 0, 600 + (i * 37) % 4000).alias("width"), F.when(i % 7 != 0, 500 + (i * 53) % 3000).alias("height")
    )
    return H.tier_demand(e)


@query(
    "capture_sessions",
    "camera:i capture:i start_us:i end_us:i events:i",
    fx.F5,
    f"""SELECT camera, capture, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS events FROM (
      SELECT *, sum((p IS NULL OR t_us - p > {HOUR // 2})::INT) OVER ({CAM}) AS capture FROM (SELECT *, lag(t_us) OVER ({CAM}) AS p FROM cam)) GROUP BY camera, capture""",
)
def _(spark, sf):
    return H.capture_sessions(fx.camera_events(spark, sf), HOUR // 2)


@query(
    "activity_summary",
    "camera:i client:i hour:i events:i captured:i rejected:i total_value:d level:i",
    [*fx.F5, f"h AS (SELECT *, t_us // {HOUR} AS hour FROM cam)"],
    "SELECT camera, client, hour, count(*) AS events, count(*) FILTER (kind = 'captured') AS captured, count(*) FILTER (kind = 'rejected') AS rejected, sum(value) AS total_value, grouping_id(camera, client, hour) AS level FROM h GROUP BY ROLLUP (camera, client, hour)",
)
def _(spark, sf):
    return H.activity_summary(fx.camera_events(spark, sf))


@query("activity_cube", "camera:i kind:s events:i level:i", fx.F5, "SELECT camera, kind, count(*) AS events, grouping_id(camera, kind) AS level FROM cam GROUP BY CUBE (camera, kind)")
def _(spark, sf):
    return H.activity_cube(fx.camera_events(spark, sf))


@query(
    "first_per_window",
    "camera:i kind:s slot:i t_us:i event_id:i",
    fx.F5,
    f"SELECT camera, kind, t_us // {HOUR} AS slot, min(t_us) AS t_us, arg_min(event_id, (t_us, event_id)) AS event_id FROM cam GROUP BY camera, kind, t_us // {HOUR}",
)
def _(spark, sf):
    return H.first_per_window(fx.camera_events(spark, sf), HOUR)
