"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Stats
from ..functions.columns import upper_median
from ..operators import pixels as P
from ..operators import stats as S
from . import fixtures as fx
from .registry import query

CH = "session, frame_id, ch"
ROBUST = f"""med AS (SELECT {CH}, median(v) AS median, min(v) AS min, max(v) AS max, count(*) AS n FROM src GROUP BY {CH}),
rstats AS (SELECT {CH}, any_value(median) AS median, median(abs(v - median)) AS mad, any_value(min) AS min, any_value(max) AS max, any_value(n) AS n,
  1.4826::DOUBLE * median(abs(v - median)) AS sigma FROM src JOIN med USING ({CH}) GROUP BY {CH})"""
LUM = "lum AS (SELECT session, frame_id, y, x, sum(v * CASE ch WHEN 0 THEN 0.2126::DOUBLE WHEN 1 THEN 0.7152::DOUBLE ELSE 0.0722::DOUBLE END) AS v FROM mosaic GROUP BY session, frame_id, y, x)"
STATS = "session:i frame_id:i ch:i median:d mad:d sigma:d min:d max:d n:i"


@query(
    "median_exact",
    "session:i frame_id:i median:d upper:d",
    fx.F1,
    "SELECT session, frame_id, median(v) AS median, list_sort(list(v))[33] AS upper FROM pixels GROUP BY session, frame_id",
)
def _(spark, sf):
    px = fx.pixels(spark, sf)
    return px.groupBy("session", "frame_id").agg(F.median("v").alias("median"), upper_median("v").alias("upper"))


@query("channel_stats", STATS, [*fx.F3M, "src AS (SELECT * FROM mosaic)", ROBUST], "SELECT * FROM rstats")
def _(spark, sf):
    return S.image_stats(*fx.mosaic(spark, sf, 3))


@query(
    "channel_stats_strided",
    STATS,
    [*fx.F3M, "src AS (SELECT * FROM mosaic WHERE (y * 48 + x) % 2 = 0)", ROBUST],
    "SELECT * FROM rstats",
)
def _(spark, sf):
    return S.image_stats(*fx.mosaic(spark, sf, 3), Stats(max_samples=1000))


@query(
    "luminance_stats",
    "session:i frame_id:i median:d mad:d sigma:d min:d max:d n:i",
    [*fx.F3M, LUM, "src AS (SELECT *, 0 AS ch FROM lum)", ROBUST],
    "SELECT * FROM rstats",
)
def _(spark, sf):
    return S.luminance_stats(*fx.mosaic(spark, sf, 3))


@query(
    "image_summary",
    "session:i frame_id:i mean_median:d mean_sigma:d global_min:d global_max:d channels:i is_low_signal:b",
    [*fx.F3M, "src AS (SELECT * FROM mosaic)", ROBUST],
    """SELECT session, frame_id, avg(median) AS mean_median, avg(sigma) AS mean_sigma, min(min) AS global_min, max(max) AS global_max,
       count(*) AS channels, avg(sigma) > 0 AND max(max) - avg(median) < avg(sigma) * 10.0 AS is_low_signal FROM rstats GROUP BY session, frame_id""",
)
def _(spark, sf):
    return S.image_summary(S.image_stats(*fx.mosaic(spark, sf, 3)))


@query(
    "suggested_levels",
    "session:i frame_id:i ch:i black_point:d signal_range:d",
    [*fx.F3M, "src AS (SELECT * FROM mosaic)", ROBUST],
    f"SELECT {CH}, greatest(median - 2.8::DOUBLE * sigma, 0.0::DOUBLE) AS black_point, max - median AS signal_range FROM rstats",
)
def _(spark, sf):
    return S.suggested_levels(S.image_stats(*fx.mosaic(spark, sf, 3)))


@query(
    "detection_background",
    "session:i frame_id:i median:d sigma:d threshold:d",
    [*fx.F2, "src AS (SELECT * FROM mosaic)", ROBUST],
    "SELECT session, frame_id, median, greatest(sigma, 1e-6) AS sigma, median + 2.0::DOUBLE * greatest(sigma, 1e-6::DOUBLE) AS threshold FROM rstats",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return S.detection_background(P.mean_luminance(px), fr, 2.0)


@query(
    "channel_mode",
    "session:i frame_id:i ch:i mode:d",
    [
        *fx.F3M,
        f"bins AS (SELECT {CH}, least(greatest(floor(v * 65535.0::DOUBLE), 0), 65535)::INT AS bin, count(*) AS n FROM mosaic GROUP BY ALL)",
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {CH} ORDER BY n DESC, bin) AS r FROM bins WHERE bin >= 10)",
    ],
    f"SELECT {CH}, bin / 65535.0::DOUBLE AS mode FROM ranked WHERE r = 1",
)
def _(spark, sf):
    return S.channel_mode(*fx.mosaic(spark, sf, 3))


BGMODE = """hist AS (SELECT session, frame_id, least(greatest(floor(v * 4095.0::DOUBLE), 0), 4095)::INT AS bin, count(*) AS n FROM lum GROUP BY ALL),
dense AS (SELECT f.session, f.frame_id, b.b AS bin, coalesce(h.n, 0) AS n
  FROM (SELECT DISTINCT session, frame_id FROM lum) f CROSS JOIN range(0, 4096) b(b) LEFT JOIN hist h ON h.session = f.session AND h.frame_id = f.frame_id AND h.bin = b.b),
smooth AS (SELECT *, CASE WHEN bin BETWEEN 2 AND 4093 THEN (sum(n) OVER (PARTITION BY session, frame_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) // 5 ELSE 0 END AS s,
  sum(n) OVER (PARTITION BY session, frame_id ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY session, frame_id) // 2 AS half FROM dense),
peak AS (SELECT *, row_number() OVER (PARTITION BY session, frame_id ORDER BY s DESC, bin) AS r FROM smooth WHERE bin BETWEEN 5 AND 1232 AND s > 0),
mid AS (SELECT session, frame_id, min(bin) AS bin FROM smooth WHERE cum >= half GROUP BY session, frame_id),
bgmode AS (SELECT mid.session, mid.frame_id, coalesce(peak.bin, mid.bin) / 4095.0::DOUBLE AS mode FROM mid LEFT JOIN peak ON peak.session = mid.session AND peak.frame_id = mid.frame_id AND peak.r = 1)"""


@query("background_mode", "session:i frame_id:i mode:d", [*fx.F3M, LUM, BGMODE], "SELECT * FROM bgmode")
def _(spark, sf):
    return S.background_mode(*fx.mosaic(spark, sf, 3))


@query(
    "signal_fraction",
    "session:i frame_id:i signal_fraction:d",
    [*fx.F3M, LUM, BGMODE, "src AS (SELECT * FROM mosaic)", ROBUST],
    """SELECT l.session, l.frame_id, avg(CASE WHEN v > mode + 2.0::DOUBLE * sg THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS signal_fraction
       FROM lum l JOIN bgmode USING (session, frame_id) JOIN (SELECT session, frame_id, avg(sigma) AS sg FROM rstats GROUP BY session, frame_id) USING (session, frame_id)
       GROUP BY l.session, l.frame_id""",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf, 3)
    levels = S.background_mode(px, fr).join(
        S.image_summary(S.image_stats(px, fr)).withColumnRenamed("mean_sigma", "sigma"), ["session", "frame_id"]
    )
    return S.signal_fraction(S.background_samples(px, fr), levels)


@query("population_std", "session:i frame_id:i quality:d", fx.F1, "SELECT session, frame_id, stddev_pop(v) AS quality FROM pixels GROUP BY session, frame_id")
def _(spark, sf):
    return S.contrast_std(P.mean_luminance(fx.pixels(spark, sf)))


def clip_ctes(src: str, keys: str, k: float, rounds: int) -> list[str]:
    out = []
    for i in range(rounds):
        prev = src if i == 0 else f"clip{i}"
        out += [
            f"m{i} AS (SELECT {keys}, median(v) AS m FROM {prev} GROUP BY {keys})",
            f"d{i} AS (SELECT {keys}, any_value(m) AS m, median(abs(v - m)) AS mad FROM {prev} JOIN m{i} USING ({keys}) GROUP BY {keys})",
            f"clip{i + 1} AS (SELECT {keys}, v FROM {prev} JOIN d{i} USING ({keys}) WHERE mad < 1e-9 OR v <= m + {k}::DOUBLE * 1.4826::DOUBLE * mad)",
        ]
    return out


@query(
    "upper_sigma_clip",
    "session:i frame_id:i clipped_median:d kept:i",
    [*fx.F2, *clip_ctes("mosaic", "session, frame_id", 2.0, 3)],
    "SELECT session, frame_id, median(v) AS clipped_median, count(*) AS kept FROM clip3 GROUP BY session, frame_id",
)
def _(spark, sf):
    return S.upper_sigma_clip(fx.mosaic(spark, sf)[0], ["session", "frame_id"], 2.0, 3)
