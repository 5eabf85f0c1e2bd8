"""Lucky imaging, debayer, rejection, background and live stacks on frames of known truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.config import BACKGROUND, CFA_PATTERNS, Background, Lucky, Rejection, Render
from pixelweave.operators import background as B
from pixelweave.operators import calibrate as C
from pixelweave.operators import debayer as D
from pixelweave.operators import lucky as L
from pixelweave.operators import pixels as P
from pixelweave.operators import stack as K
from pixelweave.operators import warp as W
from pixelweave.plans import planetary, render
from synthetic import frames_of, noise, to_array


def disc(dx=0.0, dy=0.0, blur=1.0, size=64):
    yy, xx = np.mgrid[0:size, 0:size]
    x, y = xx - 32 - dx, yy - 32 - dy
    edge = 1 / (1 + np.exp((np.hypot(x, y) - 14) / blur))
    bands = 0.15 * np.sin(x / 2.5) * np.exp(-blur / 4) + 0.1 * np.sin(y / 3.5) * np.exp(-blur / 4)
    return np.clip(0.02 + edge * (0.6 + bands), 0, 1)


MOVES = {1: (0.0, 0.0), 2: (3.0, -2.0), 3: (-4.4, 1.6), 4: (5.0, 5.0)}


@pytest.fixture(scope="module")
def planet(spark):
    return frames_of(spark, [("p", i, i, disc(dx, dy)) for i, (dx, dy) in MOVES.items()])


@pytest.mark.parametrize("search", [7, 9])
def test_alignment_recovers_offsets(planet, search):
    px, fr = planet
    lum = P.luma_luminance(px)
    ref = lum.filter("frame_id = 1").select("session", "y", "x", "v")
    rois = fr.select("session", "frame_id", *[F.lit(v).alias(n) for n, v in (("roi_x", 14), ("roi_y", 14), ("roi_w", 36), ("roi_h", 36))])
    for r in L.alignment(lum, ref, rois, fr, search).collect():
        dx, dy = MOVES[r["frame_id"]]
        assert (r["dx"], r["dy"]) == (pytest.approx(-dx, abs=0.5), pytest.approx(-dy, abs=0.5))


def test_grouped_search_equals_shift_rows(planet):
    px, fr = planet
    lum = P.luma_luminance(px)
    ref = lum.filter("frame_id = 1").select("session", "y", "x", "v")
    rois = fr.select("session", "frame_id", *[F.lit(v).alias(n) for n, v in (("roi_x", 2), ("roi_y", 20), ("roi_w", 40), ("roi_h", 30))])
    surface = L.ncc_surface(lum, ref, rois, fr, 4)
    rows = L.refine_shift(surface, L.best_shift(surface), 4)
    wide = L.shift_search(lum, ref, rois, fr, 4)
    key = lambda df: sorted((r["frame_id"], r["dx"], r["dy"], round(r["ncc"], 6), round(r["sub_dx"], 5), round(r["sub_dy"], 5)) for r in df.collect())
    assert key(rows) == key(wide)


def test_sharper_frame_scores_higher(spark):
    px, _ = frames_of(spark, [("p", 1, 1, disc(blur=0.6)), ("p", 2, 2, disc(blur=3.0))])
    s = {r["frame_id"]: r for r in L.sharpness(P.luma_luminance(px)).collect()}
    assert all(s[1][m] > s[2][m] for m in ("laplacian", "sobel", "tenengrad"))


def test_lucky_stack_end_to_end(planet):
    px, fr = planet
    r = planetary.stack_lucky(px, fr, Lucky(selection=1.0, search_radius=7, roi=(14, 14, 36, 36), auto_tracking=False, method="mean"))
    got = to_array(r.stack, 64, 64)[12:52, 12:52]
    assert np.abs(got - disc()[12:52, 12:52]).mean() < 0.02
    assert r.selected.count() == 4


def test_comet_stack_keeps_the_nucleus_and_drops_the_star(spark):
    images = []
    for i in range(8):
        img = np.full((40, 40), 0.02)
        yy, xx = np.mgrid[0:40, 0:40]
        img += 0.6 * np.exp(-((xx - 20 - i) ** 2 + (yy - 20) ** 2) / 6.0)
        img[5, 10] = 0.9  # a star that stands still
        images.append(("c", i, i, img))
    px, fr = frames_of(spark, images)
    rois = fr.select("session", "frame_id", (F.col("frame_id") + 14).cast("int").alias("roi_x"), F.lit(14).alias("roi_y"), F.lit(13).alias("roi_w"), F.lit(13).alias("roi_h"))
    stack, offsets = planetary.stack_comet(px, fr, rois, Rejection("sigma_clip", 2.0, 2.0))
    img = to_array(stack, 40, 40, "mean")
    assert img[20, 20] > 0.55 and np.nanmax(img[5, :]) < 0.1
    assert all(r["dx"] == pytest.approx(-r["frame_id"], abs=0.3) for r in offsets.collect())


@pytest.mark.parametrize("pattern", list(CFA_PATTERNS))
@pytest.mark.parametrize("size", [(8, 8), (9, 7)])
def test_constant_planes_survive_debayer(spark, pattern, size):
    h, w = size
    colour = (0.8, 0.5, 0.2)
    img = np.array([[colour[CFA_PATTERNS[pattern][(y & 1, x & 1)]] for x in range(w)] for y in range(h)])
    px, fr = frames_of(spark, [("d", 1, 1, img)])
    assert D.detect_pattern(px, fr).collect()[0]["pattern"] == pattern
    for out in (D.bilinear(px, pattern), D.variable_gradients(px, pattern, per_colour_count=True)):
        for c in range(3):
            inner = to_array(out, h, w, ch=c)[1:-1, 1:-1]
            assert np.allclose(inner, colour[c])


def test_rejection_removes_a_trail(spark):
    rows = []
    for i in range(10):
        img = np.full((6, 6), 0.3)
        if i == 4:
            img[2, :] = 0.95
        rows.append(("r", i, i, img))
    px, _ = frames_of(spark, rows)
    for method in ("sigma_clip", "min_max"):
        img = to_array(K.rejected_stack(px, Rejection(method, 2.0, 2.0)), 6, 6, "mean")
        assert np.allclose(img, 0.3)
    pulled = to_array(K.rejected_stack(px, Rejection("winsorized", 2.0, 2.0)), 6, 6, "mean")
    plain = to_array(K.stack(px), 6, 6, "mean")
    assert (np.abs(pulled - 0.3) <= np.abs(plain - 0.3) + 1e-12).all()


def test_stack_of_equal_frames_is_the_frame(spark):
    img = np.abs(noise(8, 8, 5, 0.8)) + 0.01
    px, fr = frames_of(spark, [("s", i, i, img) for i in range(5)])
    s = K.coverage(K.stack(px), fr.groupBy("session").agg(F.count("*").alias("frames")))
    assert np.allclose(to_array(s, 8, 8, "mean"), img)
    assert np.allclose(to_array(s, 8, 8, "coverage"), 1.0)
    assert np.allclose(to_array(s, 8, 8, "m2"), 0.0, atol=1e-9)


def test_warp_there_and_back(spark):
    img = disc()
    px, fr = frames_of(spark, [("w", 1, 1, img)])
    t = fr.select("session", "frame_id", *[F.lit(v).alias(n) for n, v in (("rotation", 0.2), ("scale", 1.05), ("tx", 3.0), ("ty", -2.0))])
    c, s = np.cos(0.2) / 1.05, np.sin(0.2) / 1.05
    back = fr.select("session", "frame_id", F.lit(-0.2).alias("rotation"), F.lit(1 / 1.05).alias("scale"), F.lit(-(c * 3 + s * -2)).alias("tx"), F.lit(-(c * -2 - s * 3)).alias("ty"))
    out = to_array(W.warp(W.warp(px, t, fr), back, fr), 64, 64)
    assert np.abs(out - img)[22:42, 22:42].max() < 0.03


def test_dark_and_flat(spark):
    px, _ = frames_of(spark, [("l", 1, 1, np.full((4, 4), 0.5))])
    dark, _ = frames_of(spark, [("d", i, i, np.full((4, 4), 0.1 + 0.02 * i)) for i in (1, 2)])
    flat, _ = frames_of(spark, [("f", 1, 1, np.linspace(0.4, 0.6, 16).reshape(4, 4))])
    keys = ["ch", "y", "x"]
    out, _ = C.calibrate(px, C.master_dark(dark, keys), C.master_flat(flat, keys))
    want = 0.37 / (np.linspace(0.4, 0.6, 16).reshape(4, 4) / 0.5)
    assert np.allclose(to_array(out, 4, 4), want)
    black, _ = frames_of(spark, [("f", 1, 1, np.zeros((4, 4)))])
    assert C.master_flat(black, keys).count() == 0


def test_background_gradient_goes_and_blob_stays(spark):
    yy, xx = np.mgrid[0:128, 0:128]
    slope = 0.1 + 0.001 * xx + 0.0005 * yy
    blob = 0.4 * np.exp(-((xx - 64) ** 2 + (yy - 64) ** 2) / 60.0)
    px, fr = frames_of(spark, [("b", 1, 1, slope), ("b", 2, 2, slope + blob)])
    cfg = BACKGROUND["nebulae"].__class__(cols=8, rows=8)
    out = B.subtract(px, B.estimate(px, fr, cfg), cfg)
    flat = to_array(out, 128, 128, where="frame_id = 1")
    assert flat.std() < 0.1 * slope.std()
    kept = to_array(out, 128, 128, where="frame_id = 2")
    assert kept[64, 64] - np.median(kept) > 0.3


def test_auto_aggressiveness_limits(spark):
    even, uneven = [0.5] * 9, [0.1, 0.9] * 4 + [0.5]
    df = spark.createDataFrame([(1, even), (2, uneven), (3, [0.0] * 9)], "i int, g array<double>")
    got = {r["i"]: r["a"] for r in df.select("i", B.auto_aggressiveness(F.col("g")).alias("a")).collect()}
    assert got == {1: 0.7, 2: 0.15, 3: 0.5}


def test_render_skips_what_does_not_fit(spark):
    small, big = np.full((8, 8), 0.2), np.abs(noise(40, 40, 2, 0.3)) + 0.05
    colour = np.stack([big, big * 0.9, big * 0.8], axis=2)
    pair = np.stack([big, big * 2.0], axis=2)
    px, fr = frames_of(spark, [("r", 1, 1, small), ("r", 2, 2, big), ("r", 3, 3, colour), ("r", 4, 4, pair)])
    out, status = render.render(px, fr, Render(background=Background(cols=10, rows=10)))
    s = {r["frame_id"]: (r["background_subtracted"], r["auto_stretched"], r["contrast_applied"], r["reason"]) for r in status.collect()}
    # a small frame is stretched from the samples it has; two channels are left alone and said so
    assert s == {1: (False, True, False, None), 2: (True, True, False, None), 3: (True, True, True, None), 4: (False, False, False, "2 channels, not one or three")}
    for c in (0, 1):
        assert np.array_equal(to_array(out, 40, 40, ch=c, where="frame_id = 4"), pair[:, :, c])
    assert out.count() == 64 + 1600 + 4800 + 3200
    assert out.filter("frame_id <> 4 AND (v < 0 OR v > 1)").count() == 0


def test_darkened_render_rule():
    d = Render().darkened(1.0)
    assert d.stretch.target_background == pytest.approx(0.10 * 0.6 + 0.01 * 0.4)
    assert d.contrast.strength == pytest.approx(0.8 * 0.6 + 0.4)


def test_stack_leaves_out_nan(spark):
    from pixelweave.operators import stack

    rows = [("s", f, 0, 0, 0, v) for f, v in enumerate((1.0, float("nan"), 3.0))]
    kept = stack.drop_border(spark.createDataFrame(rows, "session string, frame_id long, ch int, y int, x int, v double"))
    assert sorted(r.v for r in kept.collect()) == [1.0, 3.0]


def test_frames_outside_a_master_are_listed(spark):
    from pixelweave.operators import calibrate as C

    rows = [("s", f, 0, 0, x, 0.5) for f in (1, 2) for x in range(2)] + [("s", 2, 0, 0, 9, 0.5)]
    px = spark.createDataFrame(rows, "session string, frame_id long, ch int, y int, x int, v double")
    dark = spark.createDataFrame([(0, 0, x, 0.1) for x in range(2)], "ch int, y int, x int, dark double")
    good, rejects = C.calibrate(px, dark)
    assert sorted((r["frame_id"], round(r["v"], 6)) for r in good.collect()) == [(1, 0.4), (1, 0.4)]
    assert [(r["frame_id"], r["missing"]) for r in rejects.collect()] == [(2, 1)]
