"""Sky positions and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.columns import clamp
from ..functions.salting import CELL_ROWS, salted_join

HINTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def search(catalogue: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Entries whose designation contains the text; with a limit the first of them, shortest designation first."""
    hit = catalogue.filter(F.contains(F.lower("designation"), F.lit(text.lower())))
    if limit is None:
        return hit
    return hit.orderBy(F.length("designation"), "designation", "entry_id").limit(limit)


def by_type(catalogue: DataFrame, catalog_type: str) -> DataFrame:
    return catalogue.filter(F.col("catalog_type") == catalog_type)


def resolve_targets(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Coordinates by designation (case ignored), or the request's own where it has them."""
    c = catalogue.select(F.lower("designation").alias("_k"), "designation", F.col("ra").alias("_ra"), F.col("dec").alias("_dec"))
    j = requests.withColumn("_k", F.lower("name")).join(c, "_k", "left")
    ra, dec = F.coalesce("ra", "_ra"), F.coalesce("dec", "_dec")
    return j.select("request_id", "name", "designation", ra.alias("ra"), dec.alias("dec"), (ra.isNotNull() & dec.isNotNull()).alias("resolved"))


def separation(ra0: Column, dec0: Column, ra1: Column, dec1: Column) -> Column:
    """Angle between two directions in degrees (haversine)."""
    r0, d0, r1, d1 = (F.radians(c) for c in (ra0, dec0, ra1, dec1))
    h = F.pow(F.sin((d1 - d0) / 2.0), 2) + F.cos(d0) * F.cos(d1) * F.pow(F.sin((r1 - r0) / 2.0), 2)
    return F.degrees(2.0 * F.asin(F.sqrt(clamp(h, 0.0, 1.0))))


def bearing(ra0: Column, dec0: Column, ra1: Column, dec1: Column) -> Column:
    """Position angle from the first to the second direction, 0 = north, 90 = east."""
    r0, d0, r1, d1 = (F.radians(c) for c in (ra0, dec0, ra1, dec1))
    y = F.sin(r1 - r0) * F.cos(d1)
    x = F.cos(d0) * F.sin(d1) - F.sin(d0) * F.cos(d1) * F.cos(r1 - r0)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def pointing(pairs: DataFrame) -> DataFrame:
    """Push direction for rows with ra, dec, rotation and target_ra, target_dec.

    distance_deg, angle_deg (bearing minus field rotation), is_close (under 1 degree) and
    an eight-way celestial hint, OK when close.
    """
    args = [F.col(c) for c in ("ra", "dec", "target_ra", "target_dec")]
    p = pairs.withColumn("distance_deg", separation(*args)).withColumn("_b", bearing(*args))
    p = p.withColumn("angle_deg", F.pmod(F.col("_b") - F.col("rotation"), F.lit(360.0)))
    p = p.withColumn("is_close", F.col("distance_deg") < 1.0)
    slot = (F.pmod(F.floor((F.col("_b") + 22.5) / 45.0), F.lit(8)) + 1).cast("int")
    names = F.array(*[F.lit(h) for h in HINTS])
    return p.withColumn("direction_hint", F.when(F.col("is_close"), "OK").otherwise(F.element_at(names, slot))).drop("_b")


def within_radius(positions: DataFrame, catalogue: DataFrame, radius_deg: float, limit: int = CELL_ROWS) -> DataFrame:
    """Catalogue entries within ``radius_deg`` of each position.

    Sky cells are declination bands of the radius, cut in right ascension into steps at
    least as wide as the radius at the band's poleward edge.  A position is repeated for
    the three bands and, in each, the cells its radius can reach, so the join is an
    equi-join on (band, cell) with the distance as residual test.  Cells with more than
    ``limit`` entries are split by their count: entries get a salt, positions one copy per salt. The pairs found grow with
    the product of entries and positions.
    """
    def bands(dec: Column) -> Column:
        return F.floor((dec + 90.0) / radius_deg).cast("int")

    def cells_in(band: Column) -> Column:
        low, high = band * radius_deg - 90.0, (band + 1) * radius_deg - 90.0
        far = F.greatest(F.abs(low), F.abs(high))
        width = F.when(far >= 89.0, 360.0).otherwise(radius_deg / F.cos(F.radians(F.least(far, F.lit(89.0)))))
        return F.greatest(F.floor(360.0 / width), F.lit(1)).cast("int")

    c = catalogue.withColumn("_band", bands(F.col("dec")))
    c = c.withColumn("_n", cells_in(F.col("_band")))
    c = c.withColumn("_cell", (F.pmod(F.floor(F.pmod(F.col("ra"), F.lit(360.0)) / 360.0 * F.col("_n")), F.col("_n"))).cast("int"))
    c = c.select("entry_id", F.col("ra").alias("entry_ra"), F.col("dec").alias("entry_dec"), "_band", "_cell")
    p = positions.withColumn("_band", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: bands(F.col("dec")) + d)))
    p = p.withColumn("_n", cells_in(F.col("_band")))
    # half-width of the cone in right ascension; everything near a pole
    edge = F.abs(F.col("dec")) + radius_deg
    half = F.when(edge >= 89.9, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(radius_deg))) / F.cos(F.radians("dec")), F.lit(1.0))))
    )
    size = 360.0 / F.col("_n")
    first = F.floor((F.col("ra") - half) / size).cast("int")
    last = F.least(F.floor((F.col("ra") + half) / size).cast("int"), first + F.col("_n") - 1)
    p = p.withColumn("_cell", F.explode(F.transform(F.sequence(first, last), lambda k: F.pmod(k, F.col("_n"))))).drop("_n")
    # the pairs are far more than the rows: their number of partitions is not left to the size of the input
    partitions = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = salted_join(c, p, ["_band", "_cell"], F.col("entry_id"), limit, partitions).withColumn("distance_deg", separation(F.col("ra"), F.col("dec"), F.col("entry_ra"), F.col("entry_dec")))
    return j.filter(F.col("distance_deg") <= radius_deg).drop("_band", "_cell")


def sexagesimal(ra: Column, dec: Column) -> tuple[Column, Column]:
    """HH:MM:SS and +-DD:MM:SS, rounded to whole seconds."""
    rs = F.pmod(F.round(ra / 15.0 * 3600.0).cast("long"), F.lit(86400))
    ds = F.round(F.abs(dec) * 3600.0).cast("long")

    def parts(s: Column) -> list[Column]:
        return [F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60]

    return (
        F.format_string("%02d:%02d:%02d", *parts(rs)),
        F.format_string("%s%02d:%02d:%02d", F.when((dec < 0) & (ds > 0), "-").otherwise("+"), *parts(ds)),
    )


def attach_last_position(frames: DataFrame, solved: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """As-of join: the last solved position at or before each frame.

    ``frames``: keys, t_us, event_id.  ``solved``: keys, t_us, event_id, payload.  Both
    run through one ordered scan in range blocks instead of one task per key.
    """
    value = F.struct(F.col("t_us").alias("solved_us"), *payload)
    s = solved.select(*keys, "t_us", "event_id", F.lit(0).alias("_side"), value.alias("_p"))
    f = frames.select(*keys, "t_us", "event_id", F.lit(1).alias("_side"), F.lit(None).cast(s.schema["_p"].dataType).alias("_p"))
    order = ["t_us", "_side", "event_id"]
    b = scan.range_blocks(s.unionByName(f), keys, [F.col(c) for c in order])
    r = scan.running(b, keys, order, {"_last": ("last", F.col("_p"))})
    return r.filter("_side = 1").select(*keys, "t_us", "event_id", "_last.*")
