"""Steps of the end-to-end stack whose cost is a frame's own: maxima, star windows, votes, medians of small frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.config import Detection, Registration
from pixelweave.model import FRAME
from pixelweave.operators import detect as T
from pixelweave.operators import register as G
from pixelweave.operators import stats as S

CFG = Detection(sigma_threshold=1.0, search_radius=2, centroid_radius=3, border_margin=0, min_snr=0.0, min_star_pixels=1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def image(spark):
    # three bands of rows, equal values beside each other, a hole
    v = np.random.default_rng(3).integers(0, 40, (150, 20)) / 40.0
    v[70, 5:9] = np.nan
    rows = [("s", 1, y, x, float(a)) for (y, x), a in np.ndenumerate(v) if not np.isnan(a)]
    lum = spark.createDataFrame(rows, "session string, frame_id bigint, y int, x int, v double").repartition(5)
    frames = spark.createDataFrame([("s", 1, 20, 150)], "session string, frame_id bigint, width int, height int")
    return v, lum, frames


def test_maxima_and_windows_equal_brute_force(image):
    v, lum, frames = image
    levels = frames.select(*FRAME, F.lit(0.5).alias("median"), F.lit(0.1).alias("sigma"), F.lit(0.8).alias("threshold"))
    found = T.local_maxima(lum, frames, levels, CFG)
    h, w = v.shape
    site = {(y, x): v[y, x] for y in range(h) for x in range(w) if not np.isnan(v[y, x])}
    near = lambda y, x, r: {(b, a): site[b, a] for b in range(y - r, y + r + 1) for a in range(x - r, x + r + 1) if (b, a) in site}
    top = {p: a for p, a in site.items() if a >= 0.8 and max((b, q) for q, b in near(*p, 2).items()) == (a, p)}
    assert {(r["y"], r["x"]): r["value"] for r in found.collect()} == top
    measured = T.measure(lum, levels, found, CFG)
    got = {(r["peak_y"], r["peak_x"]): r for r in measured.collect()}
    assert set(got) == set(top) and {y // T.BAND for y, _ in top} == {0, 1, 2}
    for (y, x), r in got.items():
        win = near(y, x, 3)
        net = {p: max(a - 0.5, 0.0) for p, a in win.items()}
        flux = sum(net.values())
        ring = sorted(a for (b, c), a in near(y, x, 6).items() if max(abs(b - y), abs(c - x)) == 6)
        want = flux, sum(p[1] * n for p, n in net.items()) / flux, sum(p[0] * n for p, n in net.items()) / flux
        assert (r["flux"], r["x"], r["y"]) == pytest.approx(want, abs=1e-9)
        assert (r["peak"], r["bright_pixels"], r["local_sky"]) == (max(win.values()), sum(n > 0 for n in net.values()), ring[len(ring) // 2])
        assert sum(not np.isnan(a) for a in r["_win"]) == len(win)
    assert "SortAggregate" not in plan(found) and "collect_list" not in plan(measured)


def test_votes_equal_all_pairs_and_only_frames_are_written(spark, monkeypatch):
    rng = random.Random(6)
    # frames of many stars, of four, and of two; the last session has no reference
    sizes = {("s", 1): 14, ("s", 2): 14, ("s", 3): 13, ("s", 4): 4, ("s", 5): 2, ("t", 1): 9, ("t", 2): 12, ("t", 3): 4, ("t", 4): 4, ("t", 5): 3, ("u", 7): 8}
    rows = [(*k, i, rng.uniform(0, 300), rng.uniform(0, 300)) for k, n in sizes.items() for i in range(n)]
    stars = spark.createDataFrame(rows, "session string, frame_id bigint, star_idx int, x double, y double")
    cfg = Registration(max_stars=20, min_triangle_side=5.0, descriptor_tolerance=0.03)
    arrays = G.star_arrays(stars)
    ref = G.array_triangles(arrays.filter("frame_id = 1"), cfg)
    tri = [r.asDict() for r in G.array_triangles(arrays, cfg).collect()]
    want = {}
    for key in {(t["session"], t["frame_id"]) for t in tri}:
        mine = [t for t in tri if (t["session"], t["frame_id"]) == key]
        pairs = [(max(abs(t["d0"] - r["d0"]), abs(t["d1"] - r["d1"])), t, r) for t in mine for r in tri if (r["session"], r["frame_id"]) == (key[0], 1)]
        count = [sum(d < 0.03 * k for d, _, _ in pairs) for k in G.LEVELS]
        level = next((i for i, n in enumerate(count) if n >= 10), 0) if count[-1] else None
        votes = {}
        for d, t, r in pairs:
            for a, i in enumerate("ijk"):
                for b, j in enumerate("ijk"):
                    if d < 0.03 * G.LEVELS[level] and abs(r["opposite"][a] - t["opposite"][b]) < 0.06:
                        votes[r[i], t[j]] = votes.get((r[i], t[j]), 0) + 1
        want[key] = len(mine), level, count[level or 0], votes
    assert {w[1] for w in want.values()} > {0, None} and ("u", 7) in want
    written = []
    monkeypatch.setattr(G, "settle", lambda df: written.append(df.count()) or df.localCheckpoint())
    monkeypatch.setattr(G, "AT_ONCE", 50)
    for limit in (200, 20_000):
        got = {(r["session"], r["frame_id"]): r for r in G.counted_votes(arrays, ref, cfg, limit).collect()}
        assert {k: (r["triangles"], r["level"], r["matches"], {(v["ref"], v["tgt"]): v["votes"] for v in r["_v"]}) for k, r in got.items()} == want
    # neither a triangle nor a match is a row that is written
    assert max(written) <= len(sizes)
    assert G.blocks(arrays, 200).filter("session = 's'").first()["_blocks"] == 6


def test_small_frames_are_sorted_as_arrays(spark):
    rows = [("s", f, y, x, None if (f, x) == (2, 3) else ((f * 7 + y * 5 + x * x) % 13) / 13.0) for f in range(5) for y in range(7) for x in range(4 + f)]
    lum = spark.createDataFrame(rows, "session string, frame_id bigint, y int, x int, v double")
    frames = lum.groupBy(*FRAME).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    stats = [S.robust_stats(lum, FRAME, tasks=3, arrays=a) for a in (False, True)]
    assert sorted(map(tuple, stats[0].collect())) == sorted(map(tuple, stats[1].collect())) and stats[0].schema.names == stats[1].schema.names
    assert S.small(frames) and not S.small(frames.withColumn("width", F.lit(4096)))
    assert "Window" not in plan(S.detection_background(lum, frames, 2.0))
    assert "Window" in plan(S.detection_background(lum, frames.withColumn("width", F.lit(4096)), 2.0))
