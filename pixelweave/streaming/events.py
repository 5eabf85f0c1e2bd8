"""Health checks on event streams.

Every function takes a streaming DataFrame (it also accepts a batch one where no state
is needed) with camera, event_id, ts TIMESTAMP, t_us, kind, value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

EVENT_SCHEMA = "camera bigint, event_id bigint, client bigint, t_us bigint, ts timestamp, kind string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """Stream the event files of a folder, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Parquet sink with its checkpoint; returns the started query (available data only)."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def deduplicate(frames: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per (session, frame_number) within the watermark; later copies are dropped."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "frame_number"])


def late_frames(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``frames`` (a table of all that arrived) without a copy in ``kept`` (what `deduplicate` wrote): they came
    after the watermark had passed them, and the stream dropped them."""
    keys = ["session", "frame_number"]
    return frames.join(kept.select(*keys).distinct(), keys, "left_anti")


def frame_rates(events: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    from ..operators.health import frame_rates as batch

    return batch(events.withWatermark("ts", late), width, pd.Timedelta(width).total_seconds())


def stage_latency(samples: DataFrame, width: str = "1 minute", late: str = "1 minute", accuracy: int = 10000) -> DataFrame:
    from ..operators.health import stage_latency as batch

    return batch(samples.withWatermark("ts", late), width, accuracy)


def status_samples(events: DataFrame, width: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    from ..operators.health import status_samples as batch

    return batch(events.withWatermark("ts", late), width)


def capture_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions split by pauses of at least ``gap``, from session windows."""
    g = events.withWatermark("ts", late).groupBy("camera", F.session_window("ts", gap).alias("w")).agg(
        F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("events")
    )
    return g.select("camera", "start_us", "end_us", "events")


class _Streaks(StatefulProcessor):
    """Consecutive timeouts of one camera across batches."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        pdf = pd.concat(list(rows)).sort_values(["t_us", "event_id"])
        out = []
        for event_id, t_us, kind in zip(pdf["event_id"], pdf["t_us"], pdf["kind"]):
            if kind != "timeout":
                n = 0
                continue
            n += 1
            out.append((key[0], event_id, t_us, n, n >= self.threshold))
        self.count.update((n,))
        if out:
            yield pd.DataFrame(out, columns=["camera", "event_id", "t_us", "streak", "unresponsive"])

    def close(self) -> None:
        pass


STREAK_SCHEMA = StructType(
    [
        StructField("camera", LongType()),
        StructField("event_id", LongType()),
        StructField("t_us", LongType()),
        StructField("streak", LongType()),
        StructField("unresponsive", BooleanType()),
    ]
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timeout_streaks(events: DataFrame, threshold: int = 3) -> DataFrame:
    """Streak at every timeout; a success resets. State: one number per camera."""
    _stateful(events.sparkSession)
    kept = events.filter(F.col("kind").isin("timeout", "ok", "captured", "status")).select("camera", "event_id", "t_us", "kind")
    return kept.groupBy("camera").transformWithStateInPandas(
        statefulProcessor=_Streaks(threshold), outputStructType=STREAK_SCHEMA, outputMode="Append", timeMode="None"
    )


class _Bursts(StatefulProcessor):
    """Rejections of one camera that end a burst, counted back from each over the trailing window."""

    def __init__(self, window_us: int, threshold: int, late_us: int):
        self.window_us, self.threshold, self.late_us = window_us, threshold, late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField(c, ArrayType(LongType())) for c in ("t", "id", "told")]
        self.seen = handle.getValueState("seen", StructType([*fields, StructField("first", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        t, ids, told, first = self.seen.get() if self.seen.exists() else ([], [], [], [])
        held = list(zip(t, ids, told))
        first = tuple(first)  # the first captured frame: nothing was stacked before it
        for pdf in rows:
            for event_id, t_us, kind in zip(pdf["event_id"].tolist(), pdf["t_us"].tolist(), pdf["kind"]):
                if kind == "rejected":
                    held.append((t_us, event_id, 0))
                else:
                    first = min(first or (t_us, event_id), (t_us, event_id))
        held.sort()
        out, kept, start = [], [], 0
        for at, (t_us, event_id, told) in enumerate(held):
            while held[start][0] < t_us - self.window_us:
                start += 1
            recent = at - start + 1
            if recent >= self.threshold and not told:
                told = 1
                out.append((key[0], event_id, t_us, recent, True, not first or first > (t_us, event_id)))
            if t_us >= held[-1][0] - self.window_us - self.late_us:
                kept.append((t_us, event_id, told))
        self.seen.update(([x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept], list(first)))
        if out:
            yield pd.DataFrame(out, columns=["camera", "event_id", "t_us", "recent", "alert", "stop"])

    def close(self) -> None:
        pass


BURST_SCHEMA = StructType(
    [
        StructField("camera", LongType()),
        StructField("event_id", LongType()),
        StructField("t_us", LongType()),
        StructField("recent", LongType()),
        StructField("alert", BooleanType()),
        StructField("stop", BooleanType()),
    ]
)


def rejection_bursts(events: DataFrame, window: str = "1 second", threshold: int = 10, late: str = "10 seconds") -> DataFrame:
    """The alerts of the batch form: rejections with ``threshold`` or more in their trailing window.

    State: the rejections of the window and of ``late`` before it, so that rejections which
    arrive late still complete a burst, and the first captured frame of the camera.
    """
    _stateful(events.sparkSession)
    us = lambda text: int(pd.Timedelta(text).total_seconds() * 1_000_000)
    kept = events.filter(F.col("kind").isin("rejected", "captured")).select("camera", "event_id", "t_us", "kind")
    return kept.groupBy("camera").transformWithStateInPandas(
        statefulProcessor=_Bursts(us(window), threshold, us(late)), outputStructType=BURST_SCHEMA, outputMode="Append", timeMode="None"
    )


class _Queue(StatefulProcessor):
    """Queue warnings of one camera: entering, repeated, clearing."""

    def __init__(self, threshold: int, repeat_us: int):
        self.threshold, self.repeat_us = threshold, repeat_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("t", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        pdf = pd.concat(list(rows)).sort_values(["t_us", "event_id"])
        out = []
        for event_id, t, depth in zip(pdf["event_id"], pdf["t_us"], pdf["queue_depth"]):
            event = None
            if depth > self.threshold:
                if last < 0 or t - last >= self.repeat_us:
                    event, last = ("warning" if last < 0 else "repeated"), t
            elif last >= 0:
                event, last = "cleared", -1
            if event:
                out.append((key[0], event_id, t, depth, event))
        self.last.update((int(last),))
        if out:
            yield pd.DataFrame(out, columns=["camera", "event_id", "t_us", "queue_depth", "event"])

    def close(self) -> None:
        pass


QUEUE_SCHEMA = StructType(
    [
        StructField("camera", LongType()),
        StructField("event_id", LongType()),
        StructField("t_us", LongType()),
        StructField("queue_depth", LongType()),
        StructField("event", StringType()),
    ]
)


def queue_alerts(samples: DataFrame, threshold: int = 5, repeat_us: int = 2_000_000) -> DataFrame:
    """Queue announcements; state: the time of the last one per camera."""
    _stateful(samples.sparkSession)
    s = samples.select("camera", "event_id", "t_us", F.col("queue_depth").cast("long").alias("queue_depth"))
    return s.groupBy("camera").transformWithStateInPandas(
        statefulProcessor=_Queue(threshold, repeat_us), outputStructType=QUEUE_SCHEMA, outputMode="Append", timeMode="None"
    )
