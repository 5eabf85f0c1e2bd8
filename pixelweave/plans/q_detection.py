"""Detection queries on 48x48 mosaics."""

from __future__ import annotations


from ..config import Detection
from ..operators import detect as T
from ..operators import pixels as P
from ..operators import stats as S
from . import fixtures as fx
from .q_statistics import ROBUST
from .registry import query

CFG = Detection(sigma_threshold=2.0, search_radius=2, centroid_radius=3, border_margin=6, min_snr=1.0, min_star_pixels=3)
LEVELS = [
    *fx.F2,
    "src AS (SELECT * FROM mosaic)",
    ROBUST,
    "levels AS (SELECT session, frame_id, median, greatest(sigma, 1e-6::DOUBLE) AS sigma, median + 2.0::DOUBLE * greatest(sigma, 1e-6::DOUBLE) AS threshold FROM rstats)",
    "bright AS (SELECT m.session, m.frame_id, y, x, v FROM mosaic m JOIN levels USING (session, frame_id) WHERE v >= threshold)",
    """cand AS (SELECT a.* FROM bright a WHERE y BETWEEN 6 AND 41 AND x BETWEEN 6 AND 41 AND NOT EXISTS (
      SELECT 1 FROM bright b WHERE b.session = a.session AND b.frame_id = a.frame_id AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2
        AND (b.v > a.v OR (b.v = a.v AND (b.y > a.y OR (b.y = a.y AND b.x > a.x))))))""",
]
MEASURED = [
    *LEVELS,
    """win AS (SELECT c.session, c.frame_id, c.y AS peak_y, c.x AS peak_x, c.v AS value, m.y - c.y AS dy, m.x - c.x AS dx, m.x, m.y, m.v, median, sigma, threshold,
        CASE WHEN abs(m.y - c.y) <= 3 AND abs(m.x - c.x) <= 3 THEN greatest(m.v - median, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS net
      FROM cand c JOIN mosaic m USING (session, frame_id) JOIN levels USING (session, frame_id) WHERE abs(m.y - c.y) <= 6 AND abs(m.x - c.x) <= 6)""",
    """meas AS (SELECT session, frame_id, peak_y, peak_x, any_value(value) AS value, any_value(median) AS median, sum(net) AS flux, sum(x * net) / sum(net) AS x, sum(y * net) / sum(net) AS y,
        coalesce(max(CASE WHEN net > 0 THEN v END), 0) AS peak, sum((net > 0 AND v > threshold * 0.5)::INT) AS bright_pixels, sum(net) / (any_value(sigma) * 7.0::DOUBLE) AS snr,
        list_sort(list(v) FILTER (greatest(abs(dy), abs(dx)) = 6))[count(*) FILTER (greatest(abs(dy), abs(dx)) = 6) // 2 + 1] AS local_sky
      FROM win GROUP BY session, frame_id, peak_y, peak_x)""",
    """judged AS (SELECT *, CASE WHEN flux < 1e-6 THEN 'no flux' WHEN greatest(peak - median, 0) / flux > 0.9 THEN 'hot pixel' WHEN bright_pixels < 3 THEN 'too few pixels'
        WHEN sqrt(pow(x - peak_x, 2) + pow(y - peak_y, 2)) > 3 THEN 'centroid far from peak' WHEN snr < 1.0 THEN 'low snr' END AS reject_reason FROM meas)""",
]
FLOOD = [
    *MEASURED,
    "cell AS (SELECT w.session, w.frame_id, w.peak_y, w.peak_x, dy, dx, w.v - local_sky >= (w.value - local_sky) * 0.5 AS hot FROM win w JOIN judged j USING (session, frame_id, peak_y, peak_x) WHERE abs(dy) <= 3 AND abs(dx) <= 3 AND reject_reason IS NULL AND j.value > local_sky)",
    """flood AS (SELECT session, frame_id, peak_y, peak_x, dy, dx FROM cell WHERE dy = 0 AND dx = 0 AND hot UNION
      SELECT c.session, c.frame_id, c.peak_y, c.peak_x, c.dy, c.dx FROM flood f JOIN cell c ON c.session = f.session AND c.frame_id = f.frame_id AND c.peak_y = f.peak_y AND c.peak_x = f.peak_x
        AND abs(c.dy - f.dy) + abs(c.dx - f.dx) = 1 AND c.hot AND abs(f.dy) < 3 AND abs(f.dx) < 3)""",
    "area AS (SELECT session, frame_id, peak_y, peak_x, CASE WHEN max(greatest(abs(dy), abs(dx))) < 3 THEN 2.0::DOUBLE * sqrt(count(*) / pi()) END AS fwhm FROM flood GROUP BY session, frame_id, peak_y, peak_x)",
    "stars AS (SELECT j.session, j.frame_id, row_number() OVER (PARTITION BY j.session, j.frame_id ORDER BY flux DESC, j.peak_y, j.peak_x) - 1 AS star_idx, x, y, flux, peak, snr, fwhm FROM judged j LEFT JOIN area USING (session, frame_id, peak_y, peak_x) WHERE reject_reason IS NULL)",
]


def lum_parts(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    lum = P.mean_luminance(px)
    return lum, fr, S.detection_background(lum, fr, CFG.sigma_threshold)


@query("star_candidates", "session:i frame_id:i y:i x:i value:d", LEVELS, "SELECT session, frame_id, y, x, v AS value FROM cand")
def _(spark, sf):
    lum, fr, levels = lum_parts(spark, sf)
    return T.local_maxima(lum, fr, levels, CFG)


@query(
    "star_centroids",
    "session:i frame_id:i peak_y:i peak_x:i x:d y:d flux:d peak:d snr:d bright_pixels:i",
    MEASURED,
    "SELECT * FROM judged",
)
def _(spark, sf):
    lum, fr, levels = lum_parts(spark, sf)
    return T.measure(lum, levels, T.local_maxima(lum, fr, levels, CFG), CFG)


@query("star_reject_reasons", "session:i frame_id:i peak_y:i peak_x:i reject_reason:s", MEASURED, "SELECT * FROM judged")
def _(spark, sf):
    lum, fr, levels = lum_parts(spark, sf)
    return T.measure(lum, levels, T.local_maxima(lum, fr, levels, CFG), CFG)


@query("star_local_sky", "session:i frame_id:i peak_y:i peak_x:i local_sky:d", MEASURED, "SELECT * FROM judged")
def _(spark, sf):
    lum, fr, levels = lum_parts(spark, sf)
    return T.measure(lum, levels, T.local_maxima(lum, fr, levels, CFG), CFG)


@query("star_detection", "session:i frame_id:i star_idx:i x:d y:d flux:d peak:d snr:d fwhm:d", FLOOD, "SELECT * FROM stars")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return T.detect(P.mean_luminance(px), fr, CFG)


@query("star_brightest", "session:i frame_id:i star_idx:i flux:d", FLOOD, "SELECT * FROM stars WHERE star_idx < 12")
def _(spark, sf):
    lum, fr, levels = lum_parts(spark, sf)
    found = T.measure(lum, levels, T.local_maxima(lum, fr, levels, CFG), CFG).filter("reject_reason IS NULL")
    return T.brightest(found, 12)


@query(
    "star_frame_medians",
    "session:i frame_id:i fwhm:d snr:d stars:i",
    FLOOD,
    "SELECT session, frame_id, median(fwhm) AS fwhm, median(snr) AS snr, count(*) AS stars FROM stars GROUP BY session, frame_id",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return T.frame_medians(T.detect(P.mean_luminance(px), fr, CFG))


@query("star_detection_adaptive", "session:i frame_id:i star_idx:i x:d y:d flux:d config:s")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return T.detect_adaptive(P.mean_luminance(px), fr)


@query("star_detection_thorough", "session:i frame_id:i star_idx:i x:d y:d flux:d config:s")
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return T.detect_thorough(P.mean_luminance(px), fr)


@query(
    "detection_preset_choice",
    "session:i frame_id:i median:d sigma:d max_value:d dynamic_range:d preset:s",
    [*fx.F2, "um AS (SELECT session, frame_id, list_sort(list(v))[1153] AS median, max(v) AS max_value FROM mosaic GROUP BY session, frame_id)",
     "ud AS (SELECT m.session, m.frame_id, any_value(median) AS median, any_value(max_value) AS max_value, list_sort(list(abs(v - median)))[1153] AS mad FROM mosaic m JOIN um USING (session, frame_id) GROUP BY m.session, m.frame_id)"],
    """SELECT session, frame_id, median, greatest(1.4826::DOUBLE * mad, 1e-6) AS sigma, max_value, max_value / greatest(median, 1e-6) AS dynamic_range,
       CASE WHEN median < 0.05 THEN 'sensitive' WHEN max_value / greatest(median, 1e-6) > 50 THEN 'default' ELSE 'medium' END AS preset FROM ud""",
)
def _(spark, sf):
    px, fr = fx.mosaic(spark, sf)
    return T.analyse(P.mean_luminance(px), fr)
