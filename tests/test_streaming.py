"""Streams give what the batch forms give on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.config import Weighting
from pixelweave.operators import health as H
from pixelweave.operators import lucky as L
from pixelweave.operators import stack as K
from pixelweave.streaming import events as E
from pixelweave.streaming import live

MS = 1_000_000


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Two cameras: a burst of 10 rejections within a second, streaks of timeouts, queue ramps."""
    rows, t0, i = [], 1_700_000_000 * MS, 0

    def add(camera, second, kind, value=1.0):
        nonlocal i
        rows.append((camera, i, i, t0 + int(second * MS), kind, float(value), "{}"))
        i += 1

    for k in range(10):
        add(1, 5 + k * 0.09, "rejected")
    for k in range(6):
        add(1, 20 + k * 10, "timeout" if k != 3 else "ok")
    for k in range(9):
        add(2, 3 + k * 0.3, "rejected")  # never ten within a second
    for k, depth in enumerate([1, 7, 8, 9, 6, 5, 2, 9, 9, 1]):
        add(2, 100 + k * 0.9, "status", depth)
    for k in range(4):
        add(2, 4000 + k, "captured")
    for camera in (1, 2):
        add(camera, 20000, "status", 3)  # moves the watermark past everything
        add(camera, 40000, "status", 3)
    df = spark.createDataFrame(rows, "camera bigint, event_id bigint, client bigint, t_us bigint, kind string, value double, props string")
    df = df.withColumn("ts", F.timestamp_micros("t_us")).select("camera", "event_id", "client", "t_us", "ts", "kind", "value", "props")
    path = str(tmp_path_factory.mktemp("log"))
    for lo, hi in ((0, 12), (12, 28), (28, 10**6)):  # one file per micro-batch, in time order
        df.filter(f"event_id >= {lo} AND event_id < {hi}").coalesce(1).write.mode("append").parquet(path)
    return df, path


def drain(spark, stream, mode="append"):
    name = f"out_{np.random.randint(10**9)}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_burst_default_rule(spark, log):
    alerts = [r for r in H.rejection_bursts(log[0]).collect() if r["alert"]]
    assert [(r["camera"], r["recent"], r["stop"]) for r in alerts] == [(1, 10, True)]


def test_burst_stream(spark, log):
    out = drain(spark, E.rejection_bursts(E.read_events(spark, log[1]))).collect()
    assert {r["camera"] for r in out} == {1} and max(r["recent"] for r in out) == 10


def test_burst_stream_equals_batch(spark, tmp_path):
    # ten rejections from 0.3 s to 1.2 s lie whole in no window that slides by half a second
    t0, rows = 1_700_000_000 * MS, []
    for k in range(10):
        rows.append((1, k, 0, t0 + 300_000 + k * 100_000, "rejected", 1.0, "{}"))
    rows.append((2, 10, 0, t0, "captured", 1.0, "{}"))
    for k in range(12):
        rows.append((2, 11 + k, 0, t0 + 300_000 + k * 70_000, "rejected", 1.0, "{}"))
    df = spark.createDataFrame(rows, "camera bigint, event_id bigint, client bigint, t_us bigint, kind string, value double, props string")
    df = df.withColumn("ts", F.timestamp_micros("t_us")).select("camera", "event_id", "client", "t_us", "ts", "kind", "value", "props")
    path = str(tmp_path / "log")
    for part in ("event_id < 6 OR event_id BETWEEN 10 AND 15", "event_id BETWEEN 6 AND 9 OR event_id > 15"):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    columns = ["camera", "event_id", "t_us", "recent", "alert", "stop"]
    want = sorted(map(tuple, H.rejection_bursts(df).filter("alert").select(*columns).collect()))
    assert [(r[0], r[3], r[5]) for r in want] == [(1, 10, True), (2, 10, False), (2, 11, False), (2, 12, False)]
    got = drain(spark, E.rejection_bursts(E.read_events(spark, path))).select(*columns)
    assert sorted(map(tuple, got.collect())) == want


def test_streaks(spark, log):
    batch = H.timeout_streaks(log[0]).select("camera", "event_id", "streak", "unresponsive")
    stream = drain(spark, E.timeout_streaks(E.read_events(spark, log[1]))).select("camera", "event_id", "streak", "unresponsive")
    want = sorted(map(tuple, batch.collect()))
    assert [r[2] for r in want] == [1, 2, 3, 1, 2]
    assert sorted(map(tuple, stream.collect())) == want


def test_queue_alerts(spark, log):
    depth = lambda df: df.filter("kind = 'status'").withColumn("queue_depth", F.col("value").cast("long"))
    batch = H.queue_alerts(depth(log[0])).select("camera", "event_id", "event")
    stream = drain(spark, E.queue_alerts(depth(E.read_events(spark, log[1])))).select("camera", "event_id", "event")
    want = sorted(map(tuple, batch.collect()))
    assert [r[2] for r in want] == ["warning", "repeated", "cleared", "warning", "cleared"]
    assert sorted(map(tuple, stream.collect())) == want
    trans = [r["event"] for r in sorted(H.queue_transitions(depth(log[0])).collect(), key=lambda r: r["event_id"])]
    assert trans == ["warning", "cleared", "warning", "cleared"]


def test_capture_sessions(spark, log):
    batch = H.capture_sessions(log[0], 30 * 60 * MS).select("camera", "start_us", "end_us", "events")
    stream = drain(spark, E.capture_sessions(E.read_events(spark, log[1])))
    want = set(map(tuple, batch.collect()))
    got = set(map(tuple, stream.collect()))
    # the newest session of the stream stays open until the watermark passes it
    assert got and got <= want and all(w[1] > 1_700_030_000 * MS for w in want - got)


def test_rates_and_status(spark, log):
    stream = E.read_events(spark, log[1])
    rates = {(r["camera"], r["published"]) for r in drain(spark, E.frame_rates(stream)).collect()}
    assert (2, 4) in rates
    status = drain(spark, E.status_samples(stream)).collect()
    batch = H.status_samples(log[0]).collect()
    assert {tuple(r) for r in status} <= {tuple(r) for r in batch} and len(status) >= 2


def test_duplicates_within_watermark(spark, tmp_path):
    rows = [("s", n, n) for n in (1, 2, 2, 3, 3, 3)]
    df = spark.createDataFrame(rows, "session string, frame_number bigint, k int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r["frame_number"] for r in drain(spark, E.deduplicate(stream)).collect()) == [1, 2, 3]


@pytest.fixture(scope="module")
def frame_rows(spark):
    rows = []
    for s in ("a", "b"):
        for n in range(1, 10):
            fwhm = None if n % 4 == 0 else 2.0 + (n * 7 % 5) / 3
            for p in range(4):
                rows.append((s, n + (100 if s == "b" else 0), n, 0, p // 2, p % 2, 0.1 + (n * 13 + p * 5) % 17 / 20, fwhm, 5.0 + n * 3 % 7))
    return spark.createDataFrame(rows, "session string, frame_id bigint, frame_number bigint, ch int, y int, x int, v double, fwhm double, snr double")


def test_live_stack_equals_batch_and_survives_a_repeated_batch(spark, frame_rows, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for lo in (1, 4, 7):
        frame_rows.filter(f"frame_number BETWEEN {lo} AND {lo + 2}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(frame_rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    live.live_stack(stream, out, str(tmp_path / "cp")).awaitTermination()
    q = frame_rows.select("session", "frame_id", "frame_number", "fwhm", "snr").distinct()
    px = frame_rows.select("session", "frame_id", "ch", "y", "x", "v")
    want = K.stack(px, K.quality_weights(q, Weighting()))
    key = lambda df: sorted((r["session"], r["y"], r["x"], round(r["mean"], 9), round(r["w"], 9), r["n"]) for r in df.collect())
    assert key(live.current_stack(spark, out)) == key(want)
    # batch 1 again: same output, nothing counted twice
    again = frame_rows.filter("frame_number BETWEEN 4 AND 6")
    live.add_batch(again.select("session", "frame_id", "ch", "y", "x", "v"), again.select("session", "frame_id", "frame_number", "fwhm", "snr").distinct(), out, 1)
    assert key(live.current_stack(spark, out)) == key(want)
    live.compact(spark, out, str(tmp_path / "small"))
    assert key(live.current_stack(spark, str(tmp_path / "small"))) == key(want)


def test_levels_keep_few_tables_and_frames_count_once(spark, frame_rows, tmp_path, monkeypatch):
    """Thirteen batches at a fan of two: every frame's rows come in two of them, the first batch's row by row."""
    monkeypatch.setattr(live, "FAN", 2)
    out = str(tmp_path / "out")
    q = frame_rows.select("session", "frame_id", "frame_number", "fwhm", "snr").distinct()
    px = frame_rows.select("session", "frame_id", "frame_number", "ch", "y", "x", "v")
    cut = lambda df, b: df.filter(f"frame_number = {b + 1}" if b < 9 else f"frame_number BETWEEN {2 * (b - 9)} AND {2 * (b - 9) + 1}")
    for b in range(14):
        half = "y = 0" if b < 9 else "y = 1"
        live.add_batch(cut(px, b).filter(half).drop("frame_number"), cut(q, b), out, b)
        held = [t for t in live._tables(spark, f"{out}/sums")]
        assert len(held) <= 4 * 3 + 2
    want = K.stack(px.drop("frame_number"), K.quality_weights(q, Weighting()))
    key = lambda df: sorted((r["session"], r["y"], r["x"], round(r["mean"], 9), round(r["w"], 9), r["n"]) for r in df.collect())
    assert key(live.current_stack(spark, out)) == key(want)
    assert {r["session"]: r["frames"] for r in live._held(spark, f"{out}/frames").groupBy("session").agg(F.count("*").alias("frames")).collect()} == {"a": 9, "b": 9}
    assert live._union(spark, f"{out}/limits", live._tables(spark, f"{out}/limits")[-1:]).count() == 2


def test_live_best_equals_batch(spark, tmp_path):
    scores = spark.createDataFrame([("s", i, float(i * 37 % 11)) for i in range(30)], "session string, frame_id bigint, quality double")
    src, out = str(tmp_path / "src"), str(tmp_path / "best")
    for lo in (0, 10, 20):
        scores.filter(f"frame_id BETWEEN {lo} AND {lo + 9}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(src)
    live.live_best(stream, out, str(tmp_path / "cp"), 6).awaitTermination()
    got = {r["frame_id"] for r in live.current_best(spark, out).collect()}
    assert got == {r["frame_id"] for r in L.best_n(scores, 6).collect()}


def test_latest_only_reports_skipped(spark, frame_rows, tmp_path):
    src = str(tmp_path / "src")
    rows = frame_rows.select("session", "frame_number").distinct()
    rows.coalesce(1).write.parquet(src)
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(src)
    live.latest_only(stream, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"), ["session"], ["frame_number"], []).awaitTermination()
    assert sorted((r["session"], r["frame_number"], r["skipped"]) for r in seen) == [("a", 9, 8), ("b", 9, 8)]
