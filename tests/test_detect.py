import numpy as np
import pytest

from pixelweave.config import DETECTION, Detection
from pixelweave.operators import detect as T
from pixelweave.operators import pixels as P
from synthetic import frames_of, star_field

STARS = [(30.3, 25.7, 0.8, 1.6), (80.6, 40.2, 0.6, 2.0), (50.0, 90.5, 0.7, 1.4), (100.25, 100.75, 0.5, 1.8), (25.5, 70.1, 0.4, 1.5)]


@pytest.fixture(scope="module")
def found(spark):
    img = star_field(128, 128, STARS)
    hot = img.copy()
    hot[60, 60] = 1.0  # a hot pixel is no star
    px, fr = frames_of(spark, [("a", 1, 1, img), ("a", 2, 2, hot)])
    return T.detect(P.mean_luminance(px), fr, DETECTION["default"]).collect()


def test_positions(found):
    for frame in (1, 2):
        stars = [r for r in found if r["frame_id"] == frame]
        for x, y, _, _ in STARS:
            assert min(np.hypot(r["x"] - x, r["y"] - y) for r in stars) < 0.2


def test_hot_pixel_is_left_out(found):
    assert all(np.hypot(r["x"] - 60, r["y"] - 60) > 2 for r in found)


def test_order_is_by_flux(found):
    stars = sorted((r for r in found if r["frame_id"] == 1), key=lambda r: r["star_idx"])
    assert [r["flux"] for r in stars] == sorted((r["flux"] for r in stars), reverse=True)


def test_fwhm_within_fifteen_percent(found):
    for x, y, _, sigma in STARS:
        r = min((r for r in found if r["frame_id"] == 1), key=lambda r: np.hypot(r["x"] - x, r["y"] - y))
        assert r["fwhm"] == pytest.approx(2.3548 * sigma, rel=0.15)


def test_wide_star_has_no_fwhm(spark):
    px, fr = frames_of(spark, [("a", 1, 1, star_field(96, 96, [(48, 48, 0.8, 9.0)]))])
    cfg = Detection(centroid_radius=4, hot_pixel_threshold=0.9, max_stars=1)
    assert [r["fwhm"] for r in T.detect(P.mean_luminance(px), fr, cfg).collect()] == [None]


def test_adaptive_settles_and_keeps_all_stars(spark):
    many = [(15 + 10 * (i % 10), 15 + 10 * (i // 10), 0.3 + 0.005 * i, 1.3) for i in range(60)]
    px, fr = frames_of(spark, [("a", 1, 1, star_field(128, 128, many)), ("a", 2, 2, star_field(128, 128, STARS))])
    rows = T.detect_adaptive(P.mean_luminance(px), fr).collect()
    assert {r["config"] for r in rows if r["frame_id"] == 1} == {"fast"}
    assert sum(r["frame_id"] == 1 for r in rows) == 60
    assert {r["config"] for r in rows if r["frame_id"] == 2} == {"sensitive"}
