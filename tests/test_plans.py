"""The whole deep-sky plan, and the shape of physical plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pixelweave.config import DeepSky, Detection
from pixelweave.plans import deep_sky
from synthetic import frames_of, star_field, to_array

SF = "/root/testdata/sf0.001"
STARS = [(25 + 17 * (i % 5) + (i * 7) % 11, 22 + 18 * (i // 5) + (i * 5) % 9, 0.3 + 0.03 * i, 1.5) for i in range(20)]
SHIFTS = {1: (0, 0), 2: (4, -3), 3: (-2.5, 5.5), 4: (3, 3)}


@pytest.fixture(scope="module")
def result(spark):
    images = [("n", i, i, star_field(120, 110, [(x + dx, y + dy, p, s) for x, y, p, s in STARS], seed=i)) for i, (dx, dy) in SHIFTS.items()]
    images.append(("n", 5, 5, star_field(120, 110, [], seed=5)))  # clouds
    images.append(("n", 6, 6, star_field(90, 110, STARS[:5], seed=6)))  # another size
    px, fr = frames_of(spark, images)
    cfg = DeepSky(detection=Detection(4.0, 2, 3, 0.85, 2, 10, 30, 3.0))
    return deep_sky.stack_sessions(px, fr, cfg)


def test_verdicts(result):
    v = {r["frame_id"]: r["verdict"] for r in result.verdicts.collect()}
    assert v == {1: "stacked", 2: "stacked", 3: "stacked", 4: "stacked", 5: "rejected_stars", 6: "rejected_dimensions"}


def test_transforms_undo_the_shifts(result):
    for r in result.transforms.filter("status = 'ok'").collect():
        dx, dy = SHIFTS[r["frame_id"]]
        assert (r["tx"], r["ty"]) == (pytest.approx(-dx, abs=0.5), pytest.approx(-dy, abs=0.5))


def test_stack_has_less_noise_and_keeps_stars(result):
    img = to_array(result.stack, 110, 120, "mean")
    one = star_field(120, 110, STARS, seed=1)
    for x, y, p, _ in STARS[5:15]:
        assert img[round(y), round(x)] == pytest.approx(one[round(y), round(x)], abs=0.08)
    assert result.stack.filter("coverage > 1 OR n > 4").count() == 0


def test_statistics(result):
    s = result.stats.collect()[0]
    assert (s["frames_received"], s["frames_stacked"], s["rejected_stars"], s["rejected_dimensions"]) == (6, 4, 1, 1)
    assert s["success_rate"] == pytest.approx(400 / 6)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["stack_mean", "calibrate", "triangle_matches", "objects_within_radius", "ncc_surface", "warp_frames", "background_node_values", "star_candidates"]
)
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_stack_is_one_exchange(spark):
    text = plan(entry.queries()["stack_mean"](spark, SF))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_rejection_rounds_share_one_exchange(spark):
    assert plan(entry.queries()["reject_sigma_clip"](spark, SF)).count("Exchange") == 1


def test_neighbourhood_is_one_exchange(spark):
    text = plan(entry.queries()["sharpness_laplacian"](spark, SF))
    assert text.count("Exchange") <= 2


def test_scan_reads_only_what_is_used(spark):
    text = entry.queries()["resolve_targets"](spark, SF)._jdf.queryExecution().toString()
    assert "c_acctbal" not in text.split("== Physical Plan ==")[1]


def test_master_is_not_broadcast_above_the_threshold(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()["calibrate"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
