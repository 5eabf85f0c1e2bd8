"""The shift search handles many small frames at once, wherever the batches of rows are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelweave.operators import lucky as L

SF = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["shift_search", "alignment_with_fallback", "selection_stats"])
def test_frames_are_not_one_python_call_each(spark, name):
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "FlatMapGroupsInPandas" not in text


@pytest.mark.parametrize("rows", [7, 64, 10_000])
def test_search_equals_the_surface_of_all_shifts(spark, rows):
    rng = np.random.default_rng(5)
    images = {(s, i): rng.random((9, 10)) for s in ("a", "b") for i in range(1, 8)}
    images["a", 3] = np.full((9, 10), 0.5)  # flat: no shift
    px = spark.createDataFrame(
        [(s, i, y, x, float(v)) for (s, i), a in images.items() for (y, x), v in np.ndenumerate(a)], "session string, frame_id bigint, y int, x int, v double"
    )
    fr = px.select("session", "frame_id").distinct().select("*", F.lit(10).alias("width"), F.lit(9).alias("height"))
    i = F.col("frame_id")
    # regions of several sizes, at the edge, and one larger than its frame
    rois = fr.select("session", "frame_id", (i % 3).alias("roi_x"), (i % 2).alias("roi_y"), (4 + i % 2).alias("roi_w"), F.when(i == 7, 12).otherwise(4).alias("roi_h"))
    ref = px.filter("frame_id = 1").select("session", "y", "x", "v")
    spark.conf.set(BATCH, rows)
    try:
        got = {(r.session, r.frame_id): r for r in L.shift_search(px, ref, rois, fr, 2).collect()}
    finally:
        spark.conf.unset(BATCH)
    surface = L.ncc_surface(px, ref, rois, fr, 2)
    want = {(r.session, r.frame_id): r for r in L.refine_shift(surface, L.best_shift(surface), 2).collect()}
    assert set(got) == set(want) == {k for k in images if k not in (("a", 3), ("a", 7), ("b", 7))}
    for k, w in want.items():
        assert (got[k].dx, got[k].dy) == (w.dx, w.dy)
        assert (got[k].ncc, got[k].sub_dx, got[k].sub_dy) == pytest.approx((w.ncc, w.sub_dx, w.sub_dy), abs=1e-9)
