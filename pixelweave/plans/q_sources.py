"""End-to-end plans and round trips through files."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib

from pyspark.sql import functions as F

from ..config import DeepSky, Lucky, Rejection, Render
from ..functions import udtf
from ..model import FRAME
from ..operators import background as B
from ..operators import pixels as P
from ..operators import stack as K
from ..session import ensure_checkpoint_dir, settle
from ..sources import fits, images, raw, ser
from ..streaming import events, live
from . import deep_sky, planetary, render
from . import fixtures as fx
from .q_background import CFG as BG
from .q_detection import CFG as DET
from .q_stacking import BALANCED, WSTACK
from .registry import query

PX = "session:i frame_id:i ch:i y:i x:i v:d"


def scratch(spark) -> str:
    """A new folder beside the checkpoints: shared on a cluster, temporary in tests."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    if base.startswith("file:"):
        return tempfile.mkdtemp(prefix="files-", dir=base.removeprefix("file:").replace("///", "/"))
    raise RuntimeError("the file round trips need a checkpoint folder mounted on every node")


@query("frame_pixels_udtf", PX, fx.F1, "SELECT session, frame_id, ch, y, x, embedding[y*8+x+1] AS v FROM pixels JOIN vectors USING (session, frame_id)")
def _(spark, sf):
    udtf.register(spark)
    fx.frame_arrays(spark, sf).select("session", "frame_id", F.col("data").cast("array<double>").alias("data"), "width", "channels").createOrReplaceTempView("pixelweave_frames")
    return spark.sql("SELECT session, frame_id, p.* FROM pixelweave_frames, LATERAL frame_pixels(data, width, channels) p")


@query(
    "fits_round_trip",
    "session:i frame_id:i width:i height:i channels:i n:i total:d exposure_s:d",
    fx.F1,
    "SELECT session, frame_id, 8 AS width, 8 AS height, 1 AS channels, 64 AS n, sum(floor(v * 65535.0::DOUBLE + 0.5::DOUBLE) / 65535.0::DOUBLE) AS total, (frame_id % 30) / 2.0::DOUBLE AS exposure_s FROM pixels GROUP BY session, frame_id",
)
def _(spark, sf):
    path = scratch(spark)
    px, fr = fx.pixels(spark, sf), fx.frames(spark, sf)
    out = P.collect_frames(px, fr).select(*FRAME, "width", "height", "channels", "data", ((F.col("frame_id") % 30) / 2.0).alias("exposure_s"))
    fits.write_fits(out, path)
    back, _ = fits.fits_frames(spark, path)
    ids = F.regexp_extract("path", r"(\d+)/raw_0*(\d+)\.fits$", 1), F.regexp_extract("path", r"/raw_(\d+)\.fits$", 1)
    return back.select(
        ids[0].cast("long").alias("session"), ids[1].cast("long").alias("frame_id"), "width", "height", "channels", "exposure_s",
        F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, b: a + b).alias("total"),
    )


@query(
    "fits_header_catalogue",
    "session:i files:i width:i exposure_s:d",
    fx.F1[:1],
    "SELECT session, count(*) AS files, 8 AS width, avg((frame_id % 30) / 2.0::DOUBLE) AS exposure_s FROM vectors GROUP BY session",
)
def _(spark, sf):
    path = scratch(spark)
    out = P.collect_frames(fx.pixels(spark, sf), fx.frames(spark, sf)).select(
        *FRAME, "width", "height", "channels", "data", ((F.col("frame_id") % 30) / 2.0).alias("exposure_s")
    )
    fits.write_fits(out, path, kind="stacked")
    h = fits.fits_headers(spark, path).withColumn("session", F.regexp_extract("path", r"/(\d+)/stacked_\d+\.fits$", 1).cast("long"))
    return h.groupBy("session").agg(F.count("*").alias("files"), F.max("width").alias("width"), F.avg("exposure_s").alias("exposure_s"))


@query(
    "ser_round_trip",
    "session:i frame_number:i channels:i n:i total:d",
    fx.F1,
    "SELECT session, frame_number, 3 AS channels, 192 AS n, 3 * sum(floor(v * 65535.0::DOUBLE + 0.5::DOUBLE) / 65535.0::DOUBLE) AS total FROM pixels GROUP BY session, frame_number",
)
def _(spark, sf):
    path = scratch(spark)
    fr = fx.frames(spark, sf)
    data = P.collect_frames(fx.pixels(spark, sf), fr).join(fr.select(*FRAME, "frame_number"), FRAME)
    ser.write_ser(data, path, part_frames=16).foreach(lambda r: None)
    s = ser.ser_frames(spark, path)
    part = F.regexp_extract("path", r"/(\d+)/part_(\d+)\.ser$", 2).cast("long")
    return s.select(
        F.regexp_extract("path", r"/(\d+)/part_\d+\.ser$", 1).cast("long").alias("session"),
        (part * 16 + F.col("frame_number")).alias("frame_number"), "channels", F.size("data").alias("n"),
        F.aggregate("data", F.lit(0.0), lambda a, b: a + b).alias("total"),
    )


@query(
    "session_parquet_round_trip",
    PX,
    fx.F1,
    "SELECT session, frame_id, ch, y, x, v FROM pixels",
)
def _(spark, sf):
    path = scratch(spark)
    raw.save_session(fx.pixels(spark, sf), path, "raw")
    return raw.load_session(spark, path, "raw")


@query(
    "raw_bytes_decode",
    "session:i frame_id:i n:i total:d",
    fx.F1,
    "SELECT session, frame_id, 64 AS n, sum(floor(v * 255.0::DOUBLE + 0.5::DOUBLE) / 255.0::DOUBLE) AS total FROM pixels GROUP BY session, frame_id",
)
def _(spark, sf):
    px = P.to_8bit(fx.pixels(spark, sf)).withColumn("v", F.col("u8").cast("double"))
    f = P.collect_frames(px.drop("u8"), fx.frames(spark, sf))
    hexed = F.array_join(F.transform("data", lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    good, _ = raw.decode_raw(f.select(*FRAME, "width", "height", "channels", F.unhex(hexed).alias("content"), F.lit("Rgb8").alias("pixel_format")))
    return good.select(*FRAME, F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query(
    "raw_bytes_rejects",
    "session:i frame_id:i reason:s",
    fx.F1[:1],
    "SELECT session, frame_id, 'Invalid data size: expected 128 bytes, got 64' AS reason FROM vectors",
)
def _(spark, sf):
    f = fx.frames(spark, sf).select(*FRAME, "width", "height", "channels", F.unhex(F.repeat(F.lit("7f"), 64)).alias("content"), F.lit("Bayer16Be").alias("pixel_format"))
    return raw.decode_raw(f)[1]


@query(
    "live_stack_batches",
    "session:i ch:i y:i x:i w:d mean:d m2:d n:i coverage:d",
    [*fx.F4, BALANCED, WSTACK],
    "SELECT s.*, n / frames::DOUBLE AS coverage FROM wstack s JOIN (SELECT session, count(*) AS frames FROM weights GROUP BY session) USING (session)",
)
def _(spark, sf):
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/live-{uuid.uuid4().hex}"
    size = fx.numbered_vectors(spark, sf).groupBy("session").agg(F.max("frame_number").alias("_n"))
    rows = fx.pixels(spark, sf).join(fx.frame_quality(spark, sf), FRAME).join(size, "session")
    # thirds of each session, one micro-batch each; of every tenth frame the lower half comes one batch later
    third = F.floor((F.col("frame_number") - 1) * 3 / F.col("_n"))
    late = (F.col("frame_number") % 10 == 0) & (F.col("y") >= 4)
    rows = settle(rows.withColumn("_part", F.least(third + late.cast("int"), F.lit(2))).drop("_n"))
    for part in range(3):
        rows.filter(F.col("_part") == part).drop("_part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.drop("_part").schema).parquet(f"{base}/in")
        live.live_stack(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return live.current_stack(spark, f"{base}/out")


@query("deep_sky_stack", "session:i ch:i y:i x:i mean:d n:i coverage:d")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return deep_sky.stack_sessions(px, fr, DeepSky(detection=DET)).stack


@query("deep_sky_verdicts", "session:i frame_id:i stars:i residual:d verdict:s reason:s")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return deep_sky.stack_sessions(px, fr, DeepSky(detection=DET)).verdicts


@query("lucky_stack_end_to_end", "session:i ch:i y:i x:i v:d")
def _(spark, sf):
    config = Lucky(selection=0.25, min_frames=5, search_radius=2, roi=(2, 2, 4, 4), auto_tracking=False)
    return planetary.stack_lucky(fx.pixels(spark, sf), fx.frames(spark, sf), config).stack


@query("lucky_stack_wide_search", "session:i frame_id:i quality:d dx:d dy:d ncc:d method:s")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return planetary.stack_lucky(px, fr, Lucky(min_frames=1, search_radius=10, roi=(8, 8, 24, 24))).scores


@query("comet_stack", "session:i ch:i y:i x:i mean:d n:i")
def _(spark, sf):
    fr = fx.frames(spark, sf)
    rois = fr.select(*FRAME, *[F.lit(v).alias(n) for n, v in (("roi_x", 1), ("roi_y", 1), ("roi_w", 6), ("roi_h", 6))])
    return planetary.stack_comet(fx.pixels(spark, sf), fr, rois, Rejection("sigma_clip", 2.0, 2.0))[0]


@query("render_frames", PX)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    return render.render(px, fr, Render(background=BG))[0]


@query(
    "render_status",
    "session:i frame_id:i background_subtracted:b auto_stretched:b saturation_boosted:b contrast_applied:b",
    fx.F2,
    "SELECT DISTINCT session, frame_id, true AS background_subtracted, true AS auto_stretched, false AS saturation_boosted, false AS contrast_applied FROM mosaic",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return render.render(px, fr, Render(background=BG))[1]


def mixed_channels(spark, sf):
    """The three-channel mosaics with every fourth frame cut to one channel and every fourth to two."""
    px, fr = fx.mosaic(spark, sf, 3)
    k = (F.col("session") + F.col("frame_id")) % 4
    left = F.when(k == 1, 1).when(k == 2, 2).otherwise(3)
    return px.filter(F.col("ch") < left), fr.withColumn("channels", left)


@query(
    "render_status_mixed",
    "session:i frame_id:i background_subtracted:b auto_stretched:b saturation_boosted:b contrast_applied:b reason:s",
    fx.F2,
    """SELECT DISTINCT session, frame_id, (session + frame_id) % 4 <> 2 AS background_subtracted, (session + frame_id) % 4 <> 2 AS auto_stretched, false AS saturation_boosted, (session + frame_id) % 4 IN (0, 3) AS contrast_applied,
       CASE WHEN (session + frame_id) % 4 = 2 THEN '2 channels, not one or three' END AS reason FROM mosaic""",
)
def _(spark, sf):
    px, fr = mixed_channels(spark, sf)
    return render.render(px, fr, Render(background=BG))[1]


@query("render_odd_channels", PX, fx.F3M, "SELECT session, frame_id, ch, y, x, v FROM mosaic WHERE (session + frame_id) % 4 = 2 AND ch < 2")
def _(spark, sf):
    px, fr = mixed_channels(spark, sf)
    out, status = render.render(px, fr, Render(background=BG))
    return out.join(status.filter("reason IS NOT NULL").select(*FRAME), FRAME, "left_semi")


@query(
    "background_custom_model",
    PX,
    fx.F3M,
    "SELECT session, frame_id, ch, y, x, greatest(v - 0.8::DOUBLE * 0.25::DOUBLE, 0) AS v FROM mosaic",
)
def _(spark, sf):
    from dataclasses import replace

    px, fr = fx.mosaic(spark, sf, 3)
    flat = lambda p, f, c: f.select(
        *FRAME, "width", "height", "channels", F.array_repeat(F.array_repeat(F.lit(0.25), c.rows * c.cols), 3).alias("grids"), F.lit(30).alias("valid_nodes")
    )
    cfg = replace(BG, gradient_only=False)
    return B.subtract(px, B.estimate(px, fr, cfg, custom=flat), cfg)


@query(
    "coverage_of_bright_samples",
    "session:i ch:i y:i x:i n:i coverage:d",
    fx.F1,
    "SELECT p.session, ch, y, x, count(*) AS n, count(*) / any_value(f)::DOUBLE AS coverage FROM pixels p JOIN (SELECT session, count(*) AS f FROM vectors GROUP BY session) USING (session) WHERE v > 0.5 GROUP BY p.session, ch, y, x HAVING count(*) > 0",
)
def _(spark, sf):
    px = fx.pixels(spark, sf).filter("v > 0.5")
    counts = fx.frames(spark, sf).groupBy("session").agg(F.count("*").alias("frames"))
    return K.coverage(K.stack(px, border=None), counts)


# ---- own functions in the end-to-end plans ---------------------------------------------


SWAPPED = """nb AS (SELECT session, frame_id, x AS y, y AS x, v * 0.05::DOUBLE + ((x * 3 + y * 5) % 8) * 0.1::DOUBLE AS v FROM pixels),
lap AS (SELECT a.session, a.frame_id, b.v + c.v + d.v + e.v - 4.0::DOUBLE * a.v AS lap FROM nb a
  JOIN nb b ON b.session = a.session AND b.frame_id = a.frame_id AND b.y = a.y - 1 AND b.x = a.x JOIN nb c ON c.session = a.session AND c.frame_id = a.frame_id AND c.y = a.y + 1 AND c.x = a.x
  JOIN nb d ON d.session = a.session AND d.frame_id = a.frame_id AND d.y = a.y AND d.x = a.x - 1 JOIN nb e ON e.session = a.session AND e.frame_id = a.frame_id AND e.y = a.y AND e.x = a.x + 1
  WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6),
rk AS (SELECT session, frame_id, row_number() OVER (PARTITION BY session ORDER BY q DESC, frame_id) AS rank, count(*) OVER (PARTITION BY session) AS total
  FROM (SELECT session, frame_id, var_pop(lap) AS q FROM lap GROUP BY session, frame_id))"""


@query(
    "lucky_stack_prewarp",
    "session:i ch:i y:i x:i v:d",
    [*fx.F1, SWAPPED],
    """SELECT p.session, 0 AS ch, y, x, coalesce(avg(CASE WHEN v > 0 THEN v END), 0) AS v FROM nb p JOIN rk USING (session, frame_id)
       WHERE rank <= least(greatest(ceil(round(total * 0.25, 9)), 5), total) GROUP BY p.session, y, x""",
)
def _(spark, sf):
    """The caller's own reshaping of the frames (rows and columns change places, the contrast goes down on top of a common
    pattern, so that all frames correlate), then the lucky plan without a search."""

    def swap(pixels, frames):
        v = F.col("v") * 0.05 + ((F.col("x") * 3 + F.col("y") * 5) % 8) * 0.1
        return pixels.select(*FRAME, "ch", F.col("x").alias("y"), F.col("y").alias("x"), v.alias("v"))

    config = Lucky(selection=0.25, min_frames=5, search_radius=0, subpixel_factor=1, method="mean", roi=(0, 0, 8, 8))
    return planetary.stack_lucky(fx.pixels(spark, sf), fx.frames(spark, sf), config, prewarp=swap).stack


@query(
    "comet_stack_tracker",
    "session:i ch:i y:i x:i mean:d n:i",
    [*fx.F1],
    """SELECT session, 0 AS ch, y, x, avg(v) AS mean, count(*) AS n FROM (
         SELECT session, y + (frame_id % 2)::INT AS y, x + (frame_id % 3)::INT AS x, v FROM pixels WHERE frame_id % 6 = 0 OR (y < 7 AND x < 7))
       WHERE y < 8 AND x < 8 AND abs(v) > 0 GROUP BY session, y, x""",
)
def _(spark, sf):
    """The caller's own tracker: whole steps from the frame id."""

    def tracker(pixels, frames, rois):
        return frames.select(*FRAME, (F.col("frame_id") % 3).cast("double").alias("dx"), (F.col("frame_id") % 2).cast("double").alias("dy"))

    fr = fx.frames(spark, sf)
    rois = fr.select(*FRAME, *[F.lit(v).alias(n) for n, v in (("roi_x", 0), ("roi_y", 0), ("roi_w", 8), ("roi_h", 8))])
    return planetary.stack_comet(fx.pixels(spark, sf), fr, rois, Rejection(), tracker)[0]


# ---- event-time dedup on a stream -------------------------------------------------------


WATERMARK = """wm AS (SELECT max(ts) - INTERVAL 10 DAY AS w FROM events WHERE event_id % 2 = 0),
arrived AS (SELECT user_id % 5 AS session, event_id AS frame_number, event_id % 2 = 1 AND ts <= w AS late FROM events, wm)"""


def deduplicated(spark, sf):
    """(what arrived, what the stream kept): the even events come first and twice, the odd ones in a second run."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex}"
    e = fx.camera_events(spark, sf).select((F.col("client") % 5).alias("session"), F.col("event_id").alias("frame_number"), "ts")
    even, odd = e.filter("frame_number % 2 = 0"), e.filter("frame_number % 2 = 1")
    for rows in (even.unionByName(even), odd):
        rows.write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(e.schema).parquet(f"{base}/in")
        events.write_stream(events.deduplicate(arriving, "10 days"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/in"), spark.read.parquet(f"{base}/out")


@query("stream_dedup", "session:i frame_number:i", [WATERMARK], "SELECT session, frame_number FROM arrived WHERE NOT late")
def _(spark, sf):
    return deduplicated(spark, sf)[1]


@query("stream_late_frames", "session:i frame_number:i", [WATERMARK], "SELECT session, frame_number FROM arrived WHERE late")
def _(spark, sf):
    return events.late_frames(*deduplicated(spark, sf))


# ---- image folders ----------------------------------------------------------------------


def grey_png(levels: bytes, w: int, h: int) -> bytes:
    """An 8-bit grey image."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + levels[i * w : (i + 1) * w] for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def image_folder(spark, sf) -> str:
    """Every frame as one image file; those with an id divisible by 10 are cut off."""
    path = scratch(spark)
    fr = fx.frame_arrays(spark, sf).select("frame_id", F.transform("data", lambda v: F.floor(F.least(F.greatest(v.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int")).alias("levels"))

    def save(batches):
        for batch in batches:
            for i, levels in zip(batch.frame_id, batch.levels):
                data = grey_png(bytes(levels.tolist()), 8, 8)
                with open(f"{path}/frame_{i}.png", "wb") as out:
                    out.write(data[:20] if i % 10 == 0 else data)
            yield batch[["frame_id"]]

    fr.mapInPandas(save, "frame_id long").count()
    return path


def image_id():
    return F.regexp_extract("path", r"frame_(\d+)\.png$", 1).cast("long").alias("frame_id")


@query(
    "image_folder_frames",
    "frame_id:i width:i height:i channels:i total:d",
    fx.F1,
    "SELECT frame_id, 8 AS width, 8 AS height, 1 AS channels, sum(floor(v * 255.0::DOUBLE + 0.5::DOUBLE) / 255.0::DOUBLE) AS total FROM pixels WHERE frame_id % 10 <> 0 GROUP BY frame_id",
)
def _(spark, sf):
    back = images.image_frames(spark, image_folder(spark, sf))
    return back.select(image_id(), "width", "height", "channels", F.aggregate("data", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("image_folder_rejects", "session:s frame_id:i reason:s", fx.F1, "SELECT 'images' AS session, frame_id, 'not a readable image' AS reason FROM vectors WHERE frame_id % 10 = 0")
def _(spark, sf):
    return images.image_rejects(spark, image_folder(spark, sf)).select("session", image_id(), "reason")
