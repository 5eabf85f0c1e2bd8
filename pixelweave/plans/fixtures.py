"""Frames, events and positions derived from the driver tables, in Spark and in SQL.

Every rule reads its whole table.  Where a session's frame count does not divide into
mosaics or colour triples, the last one is filled from the start of the session again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.columns import clamp01

MOSAIC = 6  # patches per side
SIDE = 8 * MOSAIC
PATCHES = MOSAIC * MOSAIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- F1: an embedding is an 8x8 mono frame -----------------------------------


def numbered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("session"), F.col("vec_id").alias("frame_id"), "embedding"
    )
    blocked = scan.number_blocks(e, "frame_id")
    return scan.unblocked(scan.numbered(blocked, ["session"], ["frame_id"], "frame_number"))


def frame_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_vectors(spark, sf_dir).select(
        "session",
        "frame_id",
        "frame_number",
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.lit(1).alias("channels"),
        F.col("embedding").alias("data"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_arrays(spark, sf_dir).drop("data")


def pixels(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """session, frame_id, [frame_number,] ch, y, x, v in [0, 1].

    Without ``frame_number`` no numbering is needed and the scan stays a projection.
    """
    if carry:
        src = frame_arrays(spark, sf_dir)
    else:
        src = table(spark, sf_dir, "embeddings").select(
            F.col("label").cast("long").alias("session"), F.col("vec_id").alias("frame_id"), F.col("embedding").alias("data")
        )
    e = src.select("session", "frame_id", *carry, F.posexplode("data").alias("_p", "_v"))
    return e.select(
        "session",
        "frame_id",
        *carry,
        F.lit(0).alias("ch"),
        F.floor(F.col("_p") / 8).cast("int").alias("y"),
        (F.col("_p") % 8).cast("int").alias("x"),
        clamp01(F.col("_v").cast("double") + 0.5).alias("v"),
    )


VECTORS = """vectors AS (
  SELECT label::BIGINT AS session, vec_id AS frame_id, embedding,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_number,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings)"""

PIXELS = """pixels AS (
  SELECT session, frame_id, frame_number, 0 AS ch, (p // 8)::INT AS y, (p % 8)::INT AS x,
         least(greatest(embedding[p + 1]::DOUBLE + 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS v
  FROM vectors, range(0, 64) AS t(p))"""

F1 = [VECTORS, PIXELS]


# ---- F2: 48x48 mosaics, F3: three channels -----------------------------------


def mosaic(spark: SparkSession, sf_dir: str, channels: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pixels, frames) of 48x48 mosaics; frame_id is session*1000000 + mosaic number.

    Patch p of channel c in mosaic m is frame (36m + p + 7c) mod n of the session.  Each
    frame computes the places it fills, so the mosaic needs no join back to the frames.
    """
    v = numbered_vectors(spark, sf_dir).withColumn("i", F.col("frame_number") - 1)
    size = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("session")).agg(F.count("*").alias("n"))
    v = v.join(size, "session").withColumn("mosaics", F.ceil(F.col("n") / PATCHES).cast("long"))
    slots = F.col("mosaics") * PATCHES
    per_channel = v.withColumn("ch", F.explode(F.array(*[F.lit(c) for c in range(channels)])))
    # slot s of channel c holds frame (s + 7c) mod n, so s runs over (i - 7c) mod n, + n, ...
    first = F.pmod(F.col("i") - 7 * F.col("ch"), F.col("n"))
    placed = per_channel.withColumn("_f", first).filter(F.col("_f") < slots).withColumn(
        "slot", F.explode(F.sequence(F.col("_f"), slots - 1, F.col("n")))
    )
    p = F.col("slot") % PATCHES
    px = placed.select(
        "session",
        (F.col("session") * 1000000 + F.floor(F.col("slot") / PATCHES)).alias("frame_id"),
        "ch",
        (F.floor(p / MOSAIC) * 8).cast("int").alias("_y0"),
        ((p % MOSAIC) * 8).cast("int").alias("_x0"),
        F.posexplode("embedding").alias("_p", "_v"),
    ).select(
        "session",
        "frame_id",
        "ch",
        (F.col("_y0") + F.floor(F.col("_p") / 8)).cast("int").alias("y"),
        (F.col("_x0") + F.col("_p") % 8).cast("int").alias("x"),
        clamp01(F.col("_v").cast("double") + 0.5).alias("v"),
    )
    fr = size.select(
        "session", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PATCHES).cast("long") - 1)).alias("m")
    ).select(
        "session",
        (F.col("session") * 1000000 + F.col("m")).alias("frame_id"),
        (F.col("m") + 1).alias("frame_number"),
        F.lit(SIDE).alias("width"),
        F.lit(SIDE).alias("height"),
        F.lit(channels).alias("channels"),
    )
    return px, fr


def mosaic_sql(channels: int = 1, name: str = "mosaic") -> str:
    return f"""{name} AS (
  SELECT s.session, s.session * 1000000 + m.m AS frame_id, m.m + 1 AS frame_number, c.c::INT AS ch,
         ((p.p // {MOSAIC}) * 8 + q.q // 8)::INT AS y, ((p.p % {MOSAIC}) * 8 + q.q % 8)::INT AS x,
         least(greatest(f.embedding[q.q + 1]::DOUBLE + 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS v
  FROM (SELECT session, max(n) AS n FROM vectors GROUP BY session) s,
       range(0, 1000) m(m), range(0, {PATCHES}) p(p), range(0, {channels}) c(c), range(0, 64) q(q),
       vectors f
  WHERE m.m * {PATCHES} < s.n AND f.session = s.session
    AND f.frame_number = (m.m * {PATCHES} + p.p + 7 * c.c) % s.n + 1)"""


F2 = [VECTORS, mosaic_sql(1)]
F3M = [VECTORS, mosaic_sql(3)]


def rgb(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, frames) of 8x8 colour frames: frames 3g, 3g+1, 3g+2 (mod n) are channels 0, 1, 2."""
    v = numbered_vectors(spark, sf_dir).withColumn("i", F.col("frame_number") - 1)
    size = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("session")).agg(F.count("*").alias("n"))
    v = v.join(size, "session")
    slots = F.ceil(F.col("n") / 3).cast("long") * 3
    placed = v.filter(F.col("i") < slots).withColumn("slot", F.explode(F.sequence(F.col("i"), slots - 1, F.col("n"))))
    px = placed.select(
        "session",
        (F.col("session") * 1000000 + F.floor(F.col("slot") / 3)).alias("frame_id"),
        (F.col("slot") % 3).cast("int").alias("ch"),
        F.posexplode("embedding").alias("_p", "_v"),
    ).select(
        "session",
        "frame_id",
        "ch",
        F.floor(F.col("_p") / 8).cast("int").alias("y"),
        (F.col("_p") % 8).cast("int").alias("x"),
        clamp01(F.col("_v").cast("double") + 0.5).alias("v"),
    )
    fr = size.select(
        "session", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / 3).cast("long") - 1)).alias("g")
    ).select(
        "session",
        (F.col("session") * 1000000 + F.col("g")).alias("frame_id"),
        (F.col("g") + 1).alias("frame_number"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.lit(3).alias("channels"),
    )
    return px, fr


RGB = """rgb AS (
  SELECT s.session, s.session * 1000000 + g.g AS frame_id, g.g + 1 AS frame_number, c.c::INT AS ch,
         (q.q // 8)::INT AS y, (q.q % 8)::INT AS x,
         least(greatest(f.embedding[q.q + 1]::DOUBLE + 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS v
  FROM (SELECT session, max(n) AS n FROM vectors GROUP BY session) s,
       range(0, 100000) g(g), range(0, 3) c(c), range(0, 64) q(q), vectors f
  WHERE g.g * 3 < s.n AND f.session = s.session AND f.frame_number = (g.g * 3 + c.c) % s.n + 1)"""

F3 = [VECTORS, RGB]


# ---- F4: frame quality ---------------------------------------------------------


def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir, carry=("frame_number",))
    g = px.groupBy("session", "frame_id", "frame_number").agg(
        F.stddev_pop("v").alias("_s"), F.max("v").alias("_max")
    )
    return g.select(
        "session",
        "frame_id",
        "frame_number",
        F.when(F.col("frame_id") % 7 != 0, 2.0 + F.col("_s") * 10.0).alias("fwhm"),
        (F.col("_max") / F.col("_s")).alias("snr"),
    )


QUALITY = """quality AS (
  SELECT session, frame_id, frame_number,
         CASE WHEN frame_id % 7 <> 0 THEN 2.0::DOUBLE + stddev_pop(v) * 10.0::DOUBLE END AS fwhm,
         max(v) / stddev_pop(v) AS snr
  FROM pixels GROUP BY session, frame_id, frame_number)"""

F4 = [*F1, QUALITY]


# ---- F5: camera events ---------------------------------------------------------

KINDS = {"error": "rejected", "view": "captured", "click": "timeout", "signup": "ok", "purchase": "status"}


def camera_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    t_us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return e.select(
        (F.col("user_id") % 5).alias("camera"),
        "event_id",
        F.col("user_id").alias("client"),
        t_us.alias("t_us"),
        F.timestamp_micros(t_us).alias("ts"),
        kind.alias("kind"),
        F.col("value"),
        F.col("props"),
    )


EVENTS = """cam AS (
  SELECT user_id % 5 AS camera, event_id, user_id AS client, epoch_us(ts) AS t_us,
         CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'captured' WHEN 'click' THEN 'timeout'
              WHEN 'signup' THEN 'ok' WHEN 'purchase' THEN 'status' END AS kind,
         value, props
  FROM events)"""

F5 = [EVENTS]


# ---- F6: catalogue and positions -------------------------------------------------


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("double")
    return c.select(
        F.col("c_custkey").alias("entry_id"),
        F.col("c_name").alias("designation"),
        F.col("c_mktsegment").alias("catalog_type"),
        F.pmod(k * 137.508, F.lit(360.0)).alias("ra"),
        (((F.col("c_custkey") * 61) % 1800) / 10.0 - 90.0).alias("dec"),
    )


CATALOGUE = """catalogue AS (
  SELECT c_custkey AS entry_id, c_name AS designation, c_mktsegment AS catalog_type,
         (c_custkey::DOUBLE * 137.508::DOUBLE) % 360.0::DOUBLE AS ra,
         ((c_custkey * 61) % 1800)::DOUBLE / 10.0::DOUBLE - 90.0::DOUBLE AS dec
  FROM customer)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("double")
    return s.select(
        F.col("s_suppkey").alias("position_id"),
        F.pmod(k * 137.508, F.lit(360.0)).alias("ra"),
        # folded into |dec| < 85 so that bearings stay well defined
        (((F.col("s_suppkey") * 61) % 1690) / 10.0 - 84.5).alias("dec"),
        F.pmod(k * 17.0, F.lit(360.0)).alias("rotation"),
    )


POSITIONS = """positions AS (
  SELECT s_suppkey AS position_id, (s_suppkey::DOUBLE * 137.508::DOUBLE) % 360.0::DOUBLE AS ra,
         ((s_suppkey * 61) % 1690)::DOUBLE / 10.0::DOUBLE - 84.5::DOUBLE AS dec,
         (s_suppkey::DOUBLE * 17.0::DOUBLE) % 360.0::DOUBLE AS rotation
  FROM supplier)"""

F6 = [CATALOGUE, POSITIONS]
