"""Every query that has SQL gives the SQL's rows; a spread over all areas runs here, all of them in emberframe.checks.run."""

import pytest

from conftest import SF
from emberframe.checks import everything
from emberframe.checks.run import compare

QUERIES, SQL = everything()
CHOSEN = [
    "r1_radiance_to_temperature", "r4_radiance_slope", "p1_hard_gates", "p6_along_scan", "p9_expanding_window", "p13_background_choice", "p15_full_window",
    "p28_post_correction_flags", "c2_bisection", "c4_retrieval_classes", "q1_elimination", "q5_confidence_upgrade", "q9_mask_write_back", "detect_fires",
    "g2_fixed_grid_position", "g9_bilinear_vapour", "g15_polygon_mask", "g19_pixel_area", "e3_one_vs_rest", "e13_missed_margins", "e19_tolerant_recall",
    "e29_fire_clusters", "i4_missing_ranges", "i5_same_missing_set", "i10_retry_list", "f3_class_split", "f7_balanced_sample", "m5_average_precision_by_scene",
    "m8_scene_aggregates", "x3_patch_statistics", "t1_temporal_filter", "t6_temporal_source", "t7_streaming_filter", "t9_previous_scenes", "s1_band_scan",
    "s3_calibration_sidecars", "s8_lut_validation", "s15_ragged_csv",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, SF, QUERIES[name], SQL[name])
    assert ok, note


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
