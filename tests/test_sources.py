import struct
import zlib
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import udtf
from pixelweave.sources import fits, images, raw, ser

SCHEMA = "session string, frame_id bigint, width int, height int, channels int, data array<double>, exposure_s double, gain int, camera string, cfa_pattern string, temperature double, date_obs timestamp, frame_number bigint, binning int"


def frame_rows(spark, ch: int):
    data = [i / (6 * ch - 1) for i in range(6 * ch)]
    t = datetime(2024, 3, 1, 22, 15, 30, 250000, tzinfo=timezone.utc)
    return data, spark.createDataFrame([("a", 7, 3, 2, ch, data, 2.5, 120, "Cam's", "RGGB", -10.5, t, 42, 2)], SCHEMA)


@pytest.mark.parametrize("ch", [1, 3])
@pytest.mark.parametrize("kind", ["raw", "stacked"])
def test_fits_round_trip(spark, tmp_path, ch, kind):
    data, df = frame_rows(spark, ch)
    fits.write_fits(df, str(tmp_path), kind)
    r = fits.fits_frames(spark, str(tmp_path))[0].collect()[0]
    assert np.allclose(r["data"], data, atol=1e-5)
    assert (r["width"], r["height"], r["channels"], r["gain"], r["camera"], r["exposure_s"], r["temperature"]) == (3, 2, ch, 120, "Cam's", 2.5, -10.5)
    assert r["date_obs"] == datetime(2024, 3, 1, 22, 15, 30, 250000)
    assert (r["frame_number"], r["binning"], r["cfa_pattern"]) == (42, 2, "RGGB")


def fits_file(path, bitpix, body, axes, extra=()):
    cards = [fits.card("SIMPLE", True), fits.card("BITPIX", bitpix), fits.card("NAXIS", len(axes))]
    cards += [fits.card(f"NAXIS{i + 1}", n) for i, n in enumerate(axes)] + [fits.card(k, v) for k, v in extra] + [b"END".ljust(80)]
    pad = lambda b, f: b + f * (-len(b) % 2880)
    path.write_bytes(pad(b"".join(cards), b" ") + pad(body, b"\0"))


def test_fits_types_and_rejects(spark, tmp_path):
    fits_file(tmp_path / "u8.fits", 8, bytes([0, 128, 255, 51]), (2, 2))
    fits_file(tmp_path / "i16.fits", 16, np.array([-32768, 0, 32767, 1], ">i2").tobytes(), (2, 2))
    fits_file(tmp_path / "f64.fits", -64, np.array([2.0, 4.0, 3.0, 2.0], ">f8").tobytes(), (2, 2))
    fits_file(tmp_path / "i32.fits", 32, np.zeros(4, ">i4").tobytes(), (2, 2))
    fits_file(tmp_path / "odd.fits", 8, bytes(8), (2, 2, 2))
    (tmp_path / "short.fits").write_bytes(b"SIMPLE")
    good, bad = fits.fits_frames(spark, str(tmp_path))
    v = {r["path"].split("/")[-1]: r["data"] for r in good.collect()}
    assert np.allclose(v["u8.fits"], [0, 128 / 255, 1, 0.2])
    assert np.allclose(v["i16.fits"], [0, 32768 / 65535, 1, 32769 / 65535])
    assert np.allclose(v["f64.fits"], [0, 1, 0.5, 0])
    why = {r["path"].split("/")[-1]: r["reason"] for r in bad.collect()}
    assert set(why) == {"i32.fits", "odd.fits", "short.fits"}
    assert "BITPIX 32" in why["i32.fits"] and "shape" in why["odd.fits"]


def test_fits_headers_read_no_pixels(spark, tmp_path):
    # the data block is missing on purpose
    cards = [fits.card("SIMPLE", True), fits.card("BITPIX", -32), fits.card("NAXIS", 2), fits.card("NAXIS1", 5000), fits.card("NAXIS2", 4000), fits.card("EXPOSURE", 30.0), b"END".ljust(80)]
    (tmp_path / "h.fits").write_bytes(b"".join(cards).ljust(2880))
    r = fits.fits_headers(spark, str(tmp_path)).collect()[0]
    assert (r["width"], r["height"], r["exposure_s"], r["reason"]) == (5000, 4000, 30.0, None)


def ser_file(path, colour, depth, frames, stamps=()):
    h, w = frames[0].shape[:2]
    body = b"".join(f.astype("<u1" if depth <= 8 else "<u2").tobytes() for f in frames)
    path.write_bytes(ser.header_bytes(w, h, len(frames), colour, depth, ("Obs", "Inst", "Tele")) + body + b"".join(struct.pack("<Q", s) for s in stamps))


def test_ser_kinds(spark, tmp_path):
    t = datetime(2024, 5, 1, 1, 2, 3, tzinfo=timezone.utc)
    mono = [np.full((2, 3), 10 * i) for i in range(5)]
    ser_file(tmp_path / "mono.ser", "mono", 8, mono, [ser.to_filetime(t)] * 5)
    bgr = np.arange(18).reshape(2, 3, 3) * 1000
    ser_file(tmp_path / "bgr.ser", "bgr", 16, [bgr])
    ser_file(tmp_path / "bayer.ser", "GRBG", 8, [np.arange(6).reshape(2, 3)])
    (tmp_path / "bad.ser").write_bytes(b"x" * 200)
    spark.dataSource.register(ser.SerSource)
    df = spark.read.format("ser_frames").option("path", str(tmp_path)).option("framesPerTask", "2").load()
    assert df.rdd.getNumPartitions() == 6  # 3 ranges of the mono file, one of each other
    rows = {(r["path"].split("/")[-1], r["frame_index"]): r for r in df.collect()}
    assert rows["mono.ser", 4]["data"] == pytest.approx([40 / 255] * 18)
    assert rows["mono.ser", 4]["ts"] == datetime(2024, 5, 1, 1, 2, 3)
    assert rows["mono.ser", 0]["observer"] == "Obs"
    assert rows["bgr.ser", 0]["data"] == pytest.approx(list(bgr[:, :, ::-1].reshape(-1) / 65535))
    assert (rows["bayer.ser", 0]["channels"], rows["bayer.ser", 0]["colour"]) == (1, "GRBG")
    assert rows["bad.ser", None]["reason"] == "Invalid SER signature"


def test_ser_write_splits_long_sessions(spark, tmp_path):
    rows = [("s", n, 2, 2, 1, [n / 100] * 4) for n in range(1, 11)]
    df = spark.createDataFrame(rows, "session string, frame_number bigint, width int, height int, channels int, data array<double>")
    out = ser.write_ser(df, str(tmp_path), part_frames=4).collect()
    assert sorted(r["frames"] for r in out) == [2, 4, 4]
    back = ser.ser_frames(spark, str(tmp_path))
    assert sorted(round(r["data"][0], 3) for r in back.collect()) == [n / 100 for n in range(1, 11)]


def test_ser_small_files_share_tasks(spark, tmp_path):
    for n in range(100):
        ser_file(tmp_path / f"f{n:03d}.ser", "mono", 8, [np.full((2, 3), n), np.full((2, 3), n + 1)])
    (tmp_path / "f050.ser").write_bytes(b"x" * 200)
    (tmp_path / "f060.ser").write_bytes((tmp_path / "f060.ser").read_bytes()[:-1])
    df = ser.ser_frames(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2  # 64 files a task
    rows = {(r["path"][-8:-4], r["frame_index"]): r for r in df.collect()}
    assert len(rows) == 199 and rows["f050", None]["reason"] == "Invalid SER signature"
    assert rows["f060", 1]["data"] is None and rows["f060", 1]["reason"] == "Failed to read frame data: 5 of 6 bytes"
    good = {k: r["data"] for k, r in rows.items() if r["reason"] is None}
    assert good == {(f"f{n:03d}", i): [(n + i) / 255] * 18 for n in range(100) for i in (0, 1) if n != 50 and (n, i) != (60, 1)}
    assert ser.ser_frames(spark, str(tmp_path), pixels=False).count() == 199


def test_ser_large_ranges_keep_their_tasks(spark, tmp_path):
    ser_file(tmp_path / "wide.ser", "mono", 8, [np.full((400, 500), n) for n in range(70)])
    df = ser.ser_frames(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 2  # 64 frames, then 6
    assert sorted(round(r["v"] * 255) for r in df.select(F.get("data", F.lit(599_999)).alias("v")).collect()) == list(range(70))


def png(path, img):
    h, w, n = img.shape
    raw_rows = b"".join(b"\0" + img[y].astype("u1").tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw_rows)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("bands", [1, 3, 4])
def test_image_folder(spark, tmp_path, bands):
    img = (np.arange(2 * 3 * bands).reshape(2, 3, bands) * 9).astype("u1")
    png(tmp_path / "a.png", img)
    px, fr = images.image_pixels(spark, str(tmp_path))
    f = fr.collect()[0]
    assert (f["width"], f["height"], f["channels"]) == (3, 2, 1 if bands == 1 else 3)
    for r in px.collect():
        assert r["v"] == pytest.approx(img[r["y"], r["x"], r["ch"]] / 255)


def test_raw_formats(spark):
    rows = [
        ("s", 1, 2, 1, 1, struct.pack("<2H", 0, 65535), "Rgb16"),
        ("s", 2, 2, 1, 1, struct.pack(">2H", 256, 65535), "Bayer16Be"),
        ("s", 3, 2, 1, 1, b"\x00", "Rgb8"),
        ("s", 4, 2, 1, 1, b"\x00\x01", "Rgb99"),
    ]
    df = spark.createDataFrame(rows, "session string, frame_id bigint, width int, height int, channels int, content binary, pixel_format string")
    good, bad = raw.decode_raw(df)
    assert {r["frame_id"]: r["data"] for r in good.collect()} == {1: [0.0, 1.0], 2: [256 / 65535, 1.0]}
    why = {r["frame_id"]: r["reason"] for r in bad.collect()}
    assert why[3] == "Invalid data size: expected 2 bytes, got 1" and "Rgb99" in why[4]


def test_session_layout_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0, 0, 0, 0.5), ("b", 2, 0, 0, 0, 0.6)], "session string, frame_id bigint, ch int, y int, x int, v double")
    raw.save_session(df, str(tmp_path / "o"), "raw")
    raw.save_session(df.filter("session = 'a'").withColumn("v", F.lit(0.9)), str(tmp_path / "o"), "stacked")
    raw.save_session(df.filter("session = 'a'").withColumn("v", F.lit(0.7)), str(tmp_path / "o"), "raw", mode="overwrite")
    a = raw.load_session(spark, str(tmp_path / "o"), "raw", "a")
    assert [r["v"] for r in a.collect()] == [0.7]
    assert raw.load_session(spark, str(tmp_path / "o"), "raw", "b").count() == 1
    assert "PartitionFilters: [isnotnull" in a._jdf.queryExecution().toString()


def test_frame_pixels_table_function(spark):
    udtf.register(spark)
    rows = spark.sql("SELECT * FROM frame_pixels(array(0.1D, 0.2D, 0.3D, 0.4D, 0.5D, 0.6D), 1, 3)").collect()
    assert [(r["ch"], r["y"], r["x"]) for r in rows] == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 1, 0), (1, 1, 0), (2, 1, 0)]
