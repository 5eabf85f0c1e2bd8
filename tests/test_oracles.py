"""Registered queries against DuckDB. PIXELWEAVE_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = """frame_to_pixels luminance_weighted area_downsample box_downsample dimension_check roi_crop_centred strided_sample
master_flat calibrate cfa_detect debayer_bilinear channel_stats background_mode stack_weighted_coverage quality_weights
reject_sigma_clip reject_min_max stacking_stats_rollup stack_segments_wanderer sharpness_sobel ncc_subpixel select_best_frames
lucky_stack_percentile translate_frames background_model grid_white_balance stretch_asinh_colour solve_factor_newton
output_8bit_dithered star_detection triangles_fixed similarity_fit warp_frames rejection_bursts timeout_streaks queue_alerts
capture_sessions activity_summary resolve_targets objects_within_radius last_position_per_frame raw_bytes_decode""".split()
NAMES = list(entry.queries()) if os.environ.get("PIXELWEAVE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    outcome = compare(name, entry.queries()[name](spark, SF), con, entry.oracle_sql().get(name))
    assert not outcome.startswith("MISMATCH"), outcome


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
