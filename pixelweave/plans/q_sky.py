"""Sky queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sky as N
from . import fixtures as fx
from .registry import query


@query("catalogue_search", "entry_id:i designation:s", [fx.CATALOGUE], "SELECT entry_id, designation FROM catalogue WHERE contains(lower(designation), '11')")
def _(spark, sf):
    return N.search(fx.catalogue(spark, sf), "11")


@query("catalogue_by_type", "entry_id:i designation:s catalog_type:s ra:d dec:d", [fx.CATALOGUE], "SELECT * FROM catalogue WHERE catalog_type = 'BUILDING'")
def _(spark, sf):
    return N.by_type(fx.catalogue(spark, sf), "BUILDING")


REQ = """req AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown object' ELSE upper(c_name) END AS name, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 360)::DOUBLE END AS ra, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 90)::DOUBLE END AS dec FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query(
    "resolve_targets",
    "request_id:i name:s designation:s ra:d dec:d resolved:b",
    [fx.CATALOGUE, REQ],
    "SELECT request_id, name, c.designation, coalesce(r.ra, c.ra) AS ra, coalesce(r.dec, c.dec) AS dec, coalesce(r.ra, c.ra) IS NOT NULL AS resolved FROM req r LEFT JOIN catalogue c ON lower(c.designation) = lower(r.name)",
)
def _(spark, sf):
    o, c = fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer")
    i = F.col("o_orderkey")
    req = o.join(c, o.o_custkey == c.c_custkey).select(
        i.alias("request_id"),
        F.when(i % 4 == 0, "unknown object").otherwise(F.upper("c_name")).alias("name"),
        F.when(i % 3 == 0, (i % 360).cast("double")).alias("ra"),
        F.when(i % 3 == 0, (i % 90).cast("double")).alias("dec"),
    )
    return N.resolve_targets(req, fx.catalogue(spark, sf))


SEP = "degrees(2.0::DOUBLE * asin(sqrt(least(pow(sin(radians({d1} - {d0}) / 2.0), 2) + cos(radians({d0})) * cos(radians({d1})) * pow(sin(radians({r1} - {r0}) / 2.0), 2), 1.0))))"
BEAR = "(degrees(atan2(sin(radians(tr - ra)) * cos(radians(td)), cos(radians(dec)) * sin(radians(td)) - sin(radians(dec)) * cos(radians(td)) * cos(radians(tr - ra)))) + 360.0::DOUBLE) % 360.0::DOUBLE"


@query(
    "pointing_direction",
    "position_id:i entry_id:i distance_deg:d angle_deg:d is_close:b direction_hint:s",
    [*fx.F6, "pr AS (SELECT p.*, c.entry_id, c.ra AS tr, c.dec AS td FROM catalogue c JOIN positions p ON c.entry_id = p.position_id * 3 + 1)",
     f"pb AS (SELECT *, {SEP.format(r0='ra', d0='dec', r1='tr', d1='td')} AS dist, {BEAR} AS b FROM pr)"],
    """SELECT position_id, entry_id, dist AS distance_deg, (b - rotation + 720.0::DOUBLE) % 360.0::DOUBLE AS angle_deg, dist < 1 AS is_close,
       CASE WHEN dist < 1 THEN 'OK' ELSE ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][floor((b + 22.5) / 45)::INT % 8 + 1] END AS direction_hint FROM pb""",
)
def _(spark, sf):
    pos, cat = fx.positions(spark, sf), fx.catalogue(spark, sf)
    c = cat.select(F.col("entry_id"), F.col("ra").alias("target_ra"), F.col("dec").alias("target_dec"))
    pos = pos.withColumn("entry_id", F.col("position_id") * 3 + 1)
    return N.pointing(pos.join(c, "entry_id"))



@query(
    "objects_within_radius",
    "position_id:i entry_id:i distance_deg:d",
    fx.F6,
    f"SELECT position_id, entry_id, {SEP.format(r0='p.ra', d0='p.dec', r1='c.ra', d1='c.dec')} AS distance_deg FROM positions p JOIN catalogue c ON {SEP.format(r0='p.ra', d0='p.dec', r1='c.ra', d1='c.dec')} <= 4.0",
)
def _(spark, sf):
    return N.within_radius(fx.positions(spark, sf), fx.catalogue(spark, sf), 4.0)


@query(
    "sexagesimal",
    "entry_id:i ra_string:s dec_string:s",
    [fx.CATALOGUE, "sec AS (SELECT entry_id, dec, round(ra / 15.0::DOUBLE * 3600.0::DOUBLE)::BIGINT % 86400 AS rs, round(abs(dec) * 3600.0::DOUBLE)::BIGINT AS ds FROM catalogue)"],
    """SELECT entry_id, printf('%02d:%02d:%02d', rs // 3600, (rs % 3600) // 60, rs % 60) AS ra_string,
       printf('%s%02d:%02d:%02d', CASE WHEN dec < 0 AND ds > 0 THEN '-' ELSE '+' END, ds // 3600, (ds % 3600) // 60, ds % 60) AS dec_string FROM sec""",
)
def _(spark, sf):
    ra, dec = N.sexagesimal(F.col("ra"), F.col("dec"))
    return fx.catalogue(spark, sf).select("entry_id", ra.alias("ra_string"), dec.alias("dec_string"))


@query(
    "last_position_per_frame",
    "camera:i event_id:i solved_us:i value:d",
    fx.F5,
    """SELECT f.camera, f.event_id, s.t_us AS solved_us, s.value FROM (SELECT * FROM cam WHERE kind = 'captured') f
       ASOF LEFT JOIN (SELECT camera, t_us, arg_max(value, event_id) AS value FROM cam WHERE kind = 'ok' GROUP BY camera, t_us) s ON f.camera = s.camera AND f.t_us >= s.t_us""",
)
def _(spark, sf):
    e = fx.camera_events(spark, sf)
    return N.attach_last_position(e.filter("kind = 'captured'"), e.filter("kind = 'ok'"), ["camera"], ["value"])
