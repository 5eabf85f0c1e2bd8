"""Queries on the shape of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as P
from . import fixtures as fx
from .registry import query

PX = "session:i frame_id:i ch:i y:i x:i v:d"
SITE = "session:i frame_id:i y:i x:i v:d"


@query(
    "frame_to_pixels",
    PX,
    fx.F1,
    "SELECT session, frame_id, ch, y, x, v - 0.5::DOUBLE AS v FROM (SELECT session, frame_id, ch, y, x, embedding[y*8+x+1]::DOUBLE + 0.5::DOUBLE AS v FROM pixels JOIN vectors USING (session, frame_id))",
)
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(
        F.col("label").alias("session"), F.col("vec_id").alias("frame_id"), F.col("embedding").alias("data"),
        F.lit(8).alias("width"), F.lit(1).alias("channels"),
    )
    return P.explode_frames(e)


@query(
    "pixels_to_frame",
    "session:i frame_id:i complete:b n:i first:d last:d",
    fx.F1,
    "SELECT session, frame_id, count(*) = 64 AS complete, count(*) AS n, max(CASE WHEN y*8+x = 0 THEN v END) AS first, max(CASE WHEN y*8+x = 63 THEN v END) AS last FROM pixels GROUP BY session, frame_id",
)
def _(spark, sf):
    out = P.collect_frames(fx.pixels(spark, sf), fx.frames(spark, sf))
    return out.select(
        "session", "frame_id", "complete", F.size("data").alias("n"),
        F.col("data")[0].alias("first"), F.element_at("data", -1).alias("last"),
    )


@query("luminance_mean", SITE, fx.F3, "SELECT session, frame_id, y, x, avg(v) AS v FROM rgb GROUP BY session, frame_id, y, x")
def _(spark, sf):
    return P.mean_luminance(fx.rgb(spark, sf)[0])


@query(
    "luminance_weighted",
    SITE,
    fx.F3,
    "SELECT session, frame_id, y, x, sum(v * CASE ch WHEN 0 THEN 0.2126::DOUBLE WHEN 1 THEN 0.7152::DOUBLE ELSE 0.0722::DOUBLE END) AS v FROM rgb GROUP BY session, frame_id, y, x",
)
def _(spark, sf):
    return P.luma_luminance(fx.rgb(spark, sf)[0])


@query(
    "clamp_unit",
    PX,
    [fx.VECTORS],
    "SELECT session, frame_id, 0 AS ch, p // 8 AS y, p % 8 AS x, least(greatest(embedding[p+1]::DOUBLE * 4.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS v FROM vectors, range(0, 64) t(p)",
)
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(
        F.col("label").alias("session"), F.col("vec_id").alias("frame_id"), F.col("embedding").alias("data"),
        F.lit(8).alias("width"), F.lit(1).alias("channels"),
    )
    px = P.explode_frames(e).withColumn("v", F.col("v") * 4.0)
    return P.clamp_values(px)


@query("quantise_8bit", "session:i frame_id:i y:i x:i u8:i r8:i", fx.F1, "SELECT session, frame_id, y, x, floor(v * 255.0::DOUBLE + 0.5::DOUBLE) AS u8, round(v * 255.0::DOUBLE) AS r8 FROM pixels")
def _(spark, sf):
    px = fx.pixels(spark, sf)
    return P.to_8bit(P.to_8bit(px).withColumnRenamed("u8", "_a"), half_up=False).withColumnsRenamed({"u8": "r8", "_a": "u8"})


@query(
    "area_downsample",
    PX,
    fx.F1,
    "SELECT session, frame_id, ch, y // 3 AS y, x // 3 AS x, avg(v) AS v FROM pixels WHERE y < 6 AND x < 6 GROUP BY session, frame_id, ch, y // 3, x // 3",
)
def _(spark, sf):
    return P.area_downsample(fx.pixels(spark, sf), fx.frames(spark, sf), 3)


@query(
    "box_downsample",
    PX,
    fx.F2,
    """SELECT session, frame_id, ch, ty.t AS y, tx.t AS x, avg(v) AS v FROM mosaic, range(0, 20) ty(t), range(0, 20) tx(t)
       WHERE y >= floor(ty.t * 48.0 / 20) AND y < floor((ty.t + 1) * 48.0 / 20)
         AND x >= floor(tx.t * 48.0 / 20) AND x < floor((tx.t + 1) * 48.0 / 20)
       GROUP BY session, frame_id, ch, ty.t, tx.t""",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return P.box_downsample(px, fr, 20, 30)


@query(
    "dimension_check",
    "session:i frame_id:i accepted:b reason:s",
    fx.F1[:1],
    """SELECT session, frame_id, w = 8 AND h = 8 AS accepted,
       CASE WHEN NOT (w = 8 AND h = 8) THEN 'frame is ' || w || 'x' || h || 'x1, session has 8x8x1' END AS reason
       FROM (SELECT session, frame_id, CASE WHEN frame_id % 5 = 0 THEN 16 ELSE 8 END AS w, CASE WHEN frame_id % 11 = 0 THEN 4 ELSE 8 END AS h FROM vectors)""",
)
def _(spark, sf):
    fr = fx.frames(spark, sf)
    ref = fr.select("session", "width", "height", "channels").distinct()
    odd = fr.withColumn("width", F.when(F.col("frame_id") % 5 == 0, 16).otherwise(8)).withColumn(
        "height", F.when(F.col("frame_id") % 11 == 0, 4).otherwise(8)
    )
    return P.check_dimensions(odd, ref)


@query(
    "dimension_split",
    "session:i frame_id:i side:s",
    fx.F1[:1],
    "SELECT session, frame_id, CASE WHEN frame_id % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS side FROM vectors",
)
def _(spark, sf):
    fr = fx.frames(spark, sf)
    ref = fr.select("session", "width", "height", "channels").distinct()
    odd = fr.withColumn("width", F.when(F.col("frame_id") % 5 == 0, 16).otherwise(8))
    good, bad = P.split_by_dimensions(odd, ref)
    pick = lambda d, s: d.select("session", "frame_id", F.lit(s).alias("side"))
    return pick(good, "accepted").unionByName(pick(bad, "rejected"))


@query(
    "roi_crop_centred",
    PX,
    fx.F1,
    "SELECT session, frame_id, ch, y - 1 AS y, x - 1 AS x, v FROM pixels WHERE y BETWEEN 1 AND 5 AND x BETWEEN 1 AND 5",
)
def _(spark, sf):
    fr = fx.frames(spark, sf)
    rois = fr.select("*", *[c.alias(n) for n, c in P.roi_centred(F.col("width"), F.col("height"), 5).items()])
    return P.crop(fx.pixels(spark, sf), rois)


@query(
    "roi_centred_at",
    "session:i frame_id:i roi_x:i roi_y:i roi_w:i roi_h:i cl_x:i cl_y:i cl_w:i cl_h:i",
    fx.F1[:1],
    """SELECT session, frame_id, rx AS roi_x, ry AS roi_y, least(5, 8 - rx) AS roi_w, least(3, 8 - ry) AS roi_h,
         least(rx, 3) AS cl_x, least(ry, 5) AS cl_y, 5 AS cl_w, 3 AS cl_h
       FROM (SELECT session, frame_id, floor(greatest(frame_id % 8 - 2.5, 0.0))::INT AS rx, floor(greatest((frame_id * 3) % 8 - 1.5, 0.0))::INT AS ry FROM vectors)""",
)
def _(spark, sf):
    fr = fx.frames(spark, sf).withColumn("cx", (F.col("frame_id") % 8).cast("double")).withColumn("cy", ((F.col("frame_id") * 3) % 8).cast("double"))
    r = fr.select("*", *[c.alias(n) for n, c in P.roi_centred_at(F.col("cx"), F.col("cy"), 5, 3, F.col("width"), F.col("height")).items()])
    cl = P.roi_clamped(F.col("roi_x"), F.col("roi_y"), F.lit(5), F.lit(3), F.col("width"), F.col("height"))
    return r.select("*", *[c.alias(n.replace("roi", "cl")) for n, c in cl.items()])


@query(
    "strided_sample",
    PX,
    fx.F2,
    "SELECT session, frame_id, ch, y, x, v FROM mosaic WHERE (y * 48 + x) % 3 = 0",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return P.strided_sample(px, fr, 700, 600)


@query(
    "normalise_min_max",
    PX,
    fx.F1,
    """SELECT session, frame_id, ch, y, x, (v - min(v) OVER w) / greatest(max(v) OVER w - min(v) OVER w, 1e-10) AS v
       FROM pixels WINDOW w AS (PARTITION BY session, frame_id)""",
)
def _(spark, sf):
    return P.normalise_frames(fx.pixels(spark, sf))
