"""Session and camera health over event rows.

``events``: camera, event_id, t_us (event time in microseconds), ts, kind, value.  The
order within a camera is (t_us, event_id).  Running values go through range blocks, so
one busy camera is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scan
from ..functions.columns import jpeg_tier, watchdog_margin_s
from ..session import settle

KEY = ["camera"]
ORDER = ["t_us", "event_id"]
EVENT = T.StructType(  # the fields any event type may carry
    [
        T.StructField("type", T.StringType()),
        T.StructField("frame_number", T.LongType()),
        T.StructField("stacked_count", T.LongType()),
        T.StructField("rejected_count", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("temperature_c", T.DoubleType()),
        T.StructField("cooler_power", T.DoubleType()),
        T.StructField("cooler_on", T.BooleanType()),
        T.StructField("queue_depth", T.LongType()),
        T.StructField("dropped_count", T.LongType()),
        T.StructField("consecutive_timeouts", T.LongType()),
        T.StructField("ra_degrees", T.DoubleType()),
        T.StructField("dec_degrees", T.DoubleType()),
        T.StructField("rotation_deg", T.DoubleType()),
        T.StructField("stars_matched", T.LongType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("k", T.LongType()),
    ]
)


def parse_events(events: DataFrame, payload: str = "props") -> DataFrame:
    """Typed columns from the JSON payload; fields a type does not carry are NULL."""
    return events.withColumn("e", F.from_json(payload, EVENT)).select(*[c for c in events.columns if c != payload], "e.*")


def blocks(events: DataFrame, keys: list[str] = KEY, order: list[str] = ORDER) -> DataFrame:
    return scan.range_blocks(events, keys, [F.col(c) for c in order])


def rejection_bursts(events: DataFrame, window_us: int = 1_000_000, threshold: int = 10) -> DataFrame:
    """Rejections of a camera within the trailing window, the current one included.

    ``alert`` from ``threshold`` on; ``stop`` while nothing has been stacked (captured) yet.
    The count is a difference of running counts: one at the event, one at a probe row
    placed just before the window, so no window of a burst sits in one task.
    """
    base = events.filter(F.col("kind").isin("rejected", "captured")).select(*KEY, *ORDER, "kind")
    rej = base.filter("kind = 'rejected'")
    # probe: after everything strictly older than the window, before its first instant
    probe = rej.select(*KEY, (F.col("t_us") - window_us).alias("t_us"), F.lit(-1).cast("long").alias("event_id"), F.lit("probe").alias("kind"), F.col("event_id").alias("of"))
    rows = base.withColumn("of", F.when(F.col("kind") == "rejected", F.col("event_id"))).unionByName(probe)
    order = [*ORDER, "of_key"]
    b = blocks(rows.withColumn("of_key", F.coalesce("of", F.lit(-1))), KEY, order)
    r = scan.running(
        b,
        KEY,
        order,
        {
            "_rej": ("sum", (F.col("kind") == "rejected").cast("long")),
            "_stk": ("sum", (F.col("kind") == "captured").cast("long")),
        },
    ).drop(scan.BLOCK)
    return (
        r.filter("of IS NOT NULL")
        .groupBy(*KEY, F.col("of").alias("event_id"))
        .agg(
            F.max(F.when(F.col("kind") == "rejected", F.col("t_us"))).alias("t_us"),
            (F.max(F.when(F.col("kind") == "rejected", F.col("_rej"))) - F.max(F.when(F.col("kind") == "probe", F.col("_rej")))).alias("recent"),
            F.max(F.when(F.col("kind") == "rejected", F.col("_stk"))).alias("_stk"),
        )
        .select(
            *KEY,
            "event_id",
            "t_us",
            "recent",
            (F.col("recent") >= threshold).alias("alert"),
            ((F.col("recent") >= threshold) & (F.col("_stk") == 0)).alias("stop"),
        )
    )


def timeout_streaks(events: DataFrame, threshold: int = 3) -> DataFrame:
    """Consecutive timeouts up to each timeout; a success (ok, captured, status) resets.

    The streak is the running count of timeouts minus that count at the last reset.
    """
    b = blocks(events.filter(F.col("kind").isin("timeout", "ok", "captured", "status")).select(*KEY, *ORDER, "kind"))
    timeout = F.col("kind") == "timeout"
    c = scan.running(b, KEY, ORDER, {"_n": ("sum", timeout.cast("long"))})
    r = scan.running(c, KEY, ORDER, {"_at": ("max", F.when(~timeout, F.col("_n")))})
    out = r.filter(timeout).withColumn("streak", F.col("_n") - F.coalesce("_at", F.lit(0)))
    return out.select(*KEY, *ORDER, "streak", (F.col("streak") >= threshold).alias("unresponsive"))


def session_counters(events: DataFrame) -> DataFrame:
    """Running counts of captured, rejected and stacked (captured minus rejected, at least 0) frames."""
    b = blocks(events.select(*KEY, *ORDER, "kind"))
    r = scan.running(
        b,
        KEY,
        ORDER,
        {
            "captured": ("sum", (F.col("kind") == "captured").cast("long")),
            "rejected": ("sum", (F.col("kind") == "rejected").cast("long")),
        },
    )
    return r.drop(scan.BLOCK).withColumn("stacked", F.greatest(F.col("captured") - F.col("rejected"), F.lit(0)))


def latest_only(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Newest row per key and how many older ones were skipped."""
    newest = F.max_by(F.struct(*order, *payload), F.struct(*order))
    g = rows.groupBy(*keys).agg(newest.alias("_n"), (F.count("*") - 1).alias("skipped"))
    return g.select(*keys, "_n.*", "skipped")


def dropped_frames(frames: DataFrame, keys: list[str] | None = None, block: int = 4096) -> DataFrame:
    """Gaps in frame_number: the frame after the gap and the number missing."""
    keys = keys or ["session"]
    b = scan.number_blocks(frames.select(*keys, "frame_number"), "frame_number", block)
    p = scan.previous(b, keys, ["frame_number"], {"_prev": F.col("frame_number")})
    gap = F.col("frame_number") - F.col("_prev") - 1
    return p.filter(gap > 0).select(*keys, "frame_number", gap.alias("dropped"))


def queue_transitions(samples: DataFrame, threshold: int = 5) -> DataFrame:
    """Rows at which the queue depth goes over the threshold (warning) or back (cleared)."""
    b = blocks(samples.select(*KEY, *ORDER, "queue_depth"))
    p = scan.previous(b, KEY, ORDER, {"_prev": F.col("queue_depth")})
    over, was = F.col("queue_depth") > threshold, F.coalesce(F.col("_prev") > threshold, F.lit(False))
    event = F.when(over & ~was, "warning").when(~over & was, "cleared")
    return p.withColumn("event", event).filter("event IS NOT NULL").select(*KEY, *ORDER, "queue_depth", "event")


def queue_alerts(samples: DataFrame, threshold: int = 5, repeat_us: int = 2_000_000) -> DataFrame:
    """All queue announcements: entering, repeated while it lasts, and clearing.

    After an announcement at t the next one is the first sample over the threshold at
    t + ``repeat_us`` or later.  Every sample over the threshold points to that
    successor; which samples are reached from an entry is found by doubling the pointers,
    so a long run takes a few joins instead of one ordered pass in one task.
    """
    b = blocks(samples.select(*KEY, *ORDER, "queue_depth"))
    p = scan.previous(b, KEY, ORDER, {"_prev": F.col("queue_depth")})
    over, was = F.col("queue_depth") > threshold, F.coalesce(F.col("_prev") > threshold, F.lit(False))
    p = p.withColumn("_enter", over & ~was).withColumn("_clear", ~over & was)
    r = scan.running(p, KEY, ORDER, {"_run": ("sum", F.col("_enter").cast("long"))}).drop(scan.BLOCK)
    r = settle(r)
    hot = r.filter(F.col("queue_depth") > threshold).select(*KEY, "_run", *ORDER, "_enter")
    # successor: the first sample at or after t + repeat, searched backwards in time
    probes = hot.select(*KEY, (F.col("t_us") + repeat_us).alias("t_us"), F.lit(-1).cast("long").alias("event_id"), "_run", F.struct(*ORDER).alias("of"))
    rows = hot.select(*KEY, *ORDER, "_run", F.lit(None).cast("struct<t_us:bigint,event_id:bigint>").alias("of")).unionByName(probes)
    rows = rows.withColumn("_rt", -F.col("t_us")).withColumn("_re", -F.col("event_id")).withColumn("_ro", F.coalesce(F.col("of.event_id"), F.lit(-1)))
    back = ["_rt", "_re", "_ro"]
    nb = scan.range_blocks(rows, KEY, [F.col(c) for c in back])
    sample = F.when(F.col("of").isNull(), F.struct(*ORDER, "_run"))
    nx = scan.running(nb, KEY, back, {"_next": ("last", sample)})
    step = nx.filter("of IS NOT NULL").filter(F.col("_next._run") == F.col("_run"))
    jump = settle(step.select(*KEY, F.col("of.event_id").alias("a"), F.col("_next.event_id").alias("b")))
    reached = settle(hot.filter("_enter").select(*KEY, F.col("event_id").alias("a")))
    # after round k the samples less than 2**(k+1) pointers from an entry are known; the table keeps the jumps of exactly
    # 2**k pointers, at most one per sample
    while True:
        more = settle(reached.join(jump, [*KEY, "a"]).select(*KEY, F.col("b").alias("a")))
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        jump = settle(jump.join(jump.select(*KEY, F.col("a").alias("b"), F.col("b").alias("c")), [*KEY, "b"]).select(*KEY, "a", F.col("c").alias("b")))
    marks = reached.distinct().select(*KEY, F.col("a").alias("event_id"), F.lit(True).alias("_hit"))
    j = r.join(marks, [*KEY, "event_id"], "left")
    event = F.when(F.col("_enter"), "warning").when(F.coalesce("_hit", F.lit(False)), "repeated").when(F.col("_clear"), "cleared")
    return j.withColumn("event", event).filter("event IS NOT NULL").select(*KEY, *ORDER, "queue_depth", "event")


def _window(ts: str, width: str) -> Column:
    return F.window(ts, width)


def stage_latency(samples: DataFrame, width: str = "1 hour", accuracy: int | None = None) -> DataFrame:
    """Count, mean, median, 95th and 99th percentile and maximum per stage and window.

    Exact percentiles come from distributed ranks; ``accuracy`` turns to mergeable
    approximate ones, which streams need.
    """
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    names = ["stage", "window_us", "samples", "mean", "p50", "p95", "p99", "worst"]
    plain = [F.count("*").alias("samples"), F.avg("value").alias("mean"), F.max("value").alias("worst")]
    if accuracy:
        g = samples.groupBy("stage", _window("ts", width).alias("_w")).agg(
            *plain, *[F.percentile_approx("value", q, accuracy).alias(n) for n, q in points.items()]
        )
        return g.withColumn("window_us", F.unix_micros(F.col("_w.start"))).select(*names)
    s = samples.withColumn("window_us", F.unix_micros(_window("ts", width)["start"]))
    keys = ["stage", "window_us"]
    ranks = scan.exact_percentiles(s, keys, "value", points)
    return s.groupBy(*keys).agg(*plain).join(ranks, keys).select(*names)


def frame_rates(events: DataFrame, width: str = "1 hour", seconds: float = 3600.0) -> DataFrame:
    """Published, dropped and skipped counts and the published rate per camera and window."""
    def count(kind: str, name: str) -> Column:
        return F.sum((F.col("kind") == kind).cast("long")).alias(name)

    g = events.groupBy(*KEY, _window("ts", width).alias("_w")).agg(
        count("captured", "published"), count("rejected", "dropped"), count("timeout", "skipped")
    )
    return g.select(*KEY, F.unix_micros(F.col("_w.start")).alias("window_us"), "published", "dropped", "skipped", (F.col("published") / seconds).alias("rate"))


def status_samples(events: DataFrame, width: str = "5 seconds") -> DataFrame:
    """Newest status value per camera and window."""
    g = events.filter("kind = 'status'").groupBy(*KEY, _window("ts", width).alias("_w")).agg(
        F.max_by("value", F.struct(*ORDER)).alias("value"), F.count("*").alias("polls")
    )
    return g.select(*KEY, F.unix_micros(F.col("_w.start")).alias("window_us"), "value", "polls")


def slow_captures(captures: DataFrame, timeout_s: float = 120.0) -> DataFrame:
    """Captures that took longer than their exposure plus the watchdog margin."""
    limit = F.col("exposure_s") + watchdog_margin_s(F.col("exposure_s"), timeout_s)
    return captures.withColumn("limit_s", limit).filter(F.col("duration_s") > F.col("limit_s"))


def tier_demand(requests: DataFrame, approximate: bool = False) -> DataFrame:
    """Requests and distinct clients per resolution tier."""
    t = requests.withColumn("tier", jpeg_tier(F.col("width"), F.col("height")))
    distinct = F.approx_count_distinct("client") if approximate else F.count_distinct("client")
    return t.groupBy("tier").agg(F.count("*").alias("requests"), distinct.alias("clients"))


def capture_sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """Group a camera's events into sessions split by pauses longer than ``gap_us``."""
    b = blocks(events.select(*KEY, *ORDER))
    p = scan.previous(b, KEY, ORDER, {"_prev": F.col("t_us")})
    new = (F.coalesce(F.col("t_us") - F.col("_prev") > gap_us, F.lit(True))).cast("long")
    s = scan.running(p.withColumn("_new", new), KEY, ORDER, {"capture": ("sum", F.col("_new"))})
    return s.groupBy(*KEY, "capture").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("events"))


def activity_summary(events: DataFrame) -> DataFrame:
    """Counts per camera, client and hour with all rolled-up levels."""
    e = events.withColumn("hour", F.floor(F.col("t_us") / 3_600_000_000))
    return e.rollup("camera", "client", "hour").agg(
        F.count("*").alias("events"),
        F.sum((F.col("kind") == "captured").cast("long")).alias("captured"),
        F.sum((F.col("kind") == "rejected").cast("long")).alias("rejected"),
        F.sum("value").alias("total_value"),
        F.grouping_id().alias("level"),
    )


def activity_cube(events: DataFrame) -> DataFrame:
    """Counts for every combination of camera and kind."""
    return events.cube("camera", "kind").agg(F.count("*").alias("events"), F.grouping_id().alias("level"))


def first_per_window(events: DataFrame, width_us: int) -> DataFrame:
    """Batch form of event-time de-duplication: the first event of a key within the window of the first one kept.

    Keys are (camera, kind); windows are aligned to ``width_us``.
    """
    e = events.withColumn("slot", F.floor(F.col("t_us") / width_us))
    return e.groupBy("camera", "kind", "slot").agg(F.min(F.struct(*ORDER)).alias("_f")).select("camera", "kind", "slot", "_f.*")
