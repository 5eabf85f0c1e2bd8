"""Tiles against the long form: halos, demosaic, resampling, sharpness, and crooked frame sizes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import tiles as TL
from pixelweave.operators import debayer as D
from pixelweave.operators import lucky as L
from pixelweave.operators import pixels as P
from pixelweave.operators import warp as W
from synthetic import frames_of

SIDE = 8
SIZES = {1: (21, 30), 2: (8, 8), 3: (17, 9), 4: (1, 5)}


@pytest.fixture(scope="module")
def sky(spark):
    rng = np.random.default_rng(5)
    px, fr = frames_of(spark, [("t", i, i, rng.random(size)) for i, size in SIZES.items()])
    return px.cache(), fr.cache()


def table(df, digits=9):
    return {(r["frame_id"], r["ch"], r["y"], r["x"]): round(r["v"], digits) for r in df.select("frame_id", "ch", "y", "x", "v").collect()}


def test_cut_and_melt_give_every_sample_back(sky):
    px, fr = sky
    tiles = TL.cut(px, fr, SIDE)
    assert table(TL.melt(tiles, SIDE)) == table(px)
    sizes = {(r["frame_id"], r["ty"], r["tx"]): (r["h"], r["w"]) for r in tiles.collect()}
    assert len(sizes) == 12 + 1 + 6 + 1
    assert sizes[1, 2, 3] == (5, 6) and sizes[3, 2, 1] == (1, 1)


def test_missing_samples_stay_missing(sky):
    px, fr = sky
    holes = px.filter("NOT (frame_id = 1 AND y < 8 AND x >= 8 AND x < 16) AND (y + x) % 5 <> 0")
    assert table(TL.melt(TL.cut(holes, fr, SIDE), SIDE)) == table(holes)


def test_frames_are_cut_where_they_are_read(spark):
    cube = np.random.default_rng(2).random((11, 13, 3))
    frames = spark.createDataFrame([("c", 7, 13, 11, 3, cube.ravel().tolist())], "session string, frame_id long, width int, height int, channels int, data array<double>")
    got = table(TL.melt(TL.of_frames(frames, SIDE), SIDE))
    assert got == {(7, c, y, x): round(cube[y, x, c], 9) for y in range(11) for x in range(13) for c in range(3)}


@pytest.mark.parametrize("algorithm", ["bilinear", "gradients"])
def test_demosaic_equals_the_long_form(sky, algorithm):
    px, fr = sky
    pattern = fr.select("session", "frame_id", F.element_at(F.array(*[F.lit(p) for p in ("RGGB", "BGGR", "GRBG", "GBRG")]), F.col("frame_id").cast("int")).alias("pattern"))
    long = D.bilinear(px, pattern) if algorithm == "bilinear" else D.variable_gradients(px, pattern)
    tiles = D.demosaic_tiles(TL.cut(px, fr, SIDE), pattern, algorithm, SIDE)
    assert table(TL.melt(tiles, SIDE)) == table(long)


def test_sharpness_equals_the_long_form(sky):
    px, fr = sky
    lum = P.luma_luminance(px)
    flat = lambda df: {r["frame_id"]: [round(r[m], 9) for m in L.QUALITY_METRICS] for r in df.collect()}
    assert flat(L.sharpness_tiles(TL.cut(lum, fr, SIDE), SIDE)) == flat(L.sharpness(lum))


def test_warp_equals_the_long_form(spark, sky):
    px, fr = sky
    moves = [("t", 1, 0.3, 1.04, 2.5, -3.25), ("t", 2, 0.0, 1.0, 0.0, 0.0), ("t", 3, -0.1, 0.93, 0.5, 1.5), ("t", 4, 0.0, 1.0, 0.0, 0.0)]
    t = spark.createDataFrame(moves, "session string, frame_id long, rotation double, scale double, tx double, ty double")
    assert table(TL.melt(W.warp_tiles(TL.cut(px, fr, SIDE), t, SIDE), SIDE)) == table(W.warp(px, t, fr))
    # a turn beyond any scale the long form expects still finds its samples
    half = spark.createDataFrame([("t", 1, np.pi, 1.0, 29.0, 20.0)], t.schema)
    turned = table(TL.melt(W.warp_tiles(TL.cut(px, fr, SIDE), half, SIDE), SIDE), 6)
    own = table(px, 6)
    assert turned and all(v == own[1, 0, 20 - y, 29 - x] for (_, _, y, x), v in turned.items())


def test_translate_equals_the_long_form(spark, sky):
    px, fr = sky
    t = spark.createDataFrame([("t", 1, 4.25, -9.5), ("t", 2, 0.0, 0.0005), ("t", 3, -1.0, 2.0), ("t", 4, 0.0, 0.0)], "session string, frame_id long, dx double, dy double")
    assert table(TL.melt(W.translate_tiles(TL.cut(px, fr, SIDE), t, SIDE), SIDE)) == table(W.translate(px, t, fr))


def test_only_strips_travel(spark, sky):
    """One row out per tile, and no exchange of tiles carries more than tile and halo."""
    px, fr = sky
    tiles = TL.cut(px, fr, SIDE).filter("frame_id = 1")
    seen = []

    def kernel(r, block):
        yield r["session"], r["frame_id"], r["ch"], r["ty"], r["tx"], *block.shape, r["fh"], r["fw"], b""

    out = TL.with_halo(tiles, 2, kernel, TL.tile_schema(tiles), SIDE).collect()
    seen = {(r["ty"], r["tx"]): (r["h"], r["w"]) for r in out}
    assert len(out) == len(seen) == 12
    assert max(h for h, _ in seen.values()) == SIDE + 4 and max(w for _, w in seen.values()) == SIDE + 4


def test_records_come_in_slices_of_bounded_bytes(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "data": [bytes(400)] * 1000})
    monkeypatch.setattr(TL, "BATCH", 4096)
    sizes, plain = [], pa.RecordBatch.slice

    class Watched:
        num_rows, nbytes = batch.num_rows, batch.nbytes

        def slice(self, at, n):
            sizes.append(n)
            return plain(batch, at, n)

    assert [r["i"] for r in TL.records(Watched())] == list(range(1000))
    assert max(sizes) * 400 <= 4096 and not list(TL.records(batch.slice(0, 0)))
