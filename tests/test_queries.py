"""Registered queries against DuckDB at the smallest scale (the full list runs with tests/compare.py)."""
import pytest
from compare import compare

from geolattice.plans import ORACLES, QUERIES

QUICK = ["P1_filter_features", "P2_select_where", "P5_box_query", "E2_E12_compare", "E20_E24_ramps", "A2_categories", "A4_quantiles", "M1_J27_apply_edits", "J1_coverage_overlap", "J3_nearest_node",
         "J2_F3_nearest_road", "J4_roads_in_radius", "O2_O3_W16_search", "G7_components", "W1_speed", "W3_drop_non_monotonic", "W5_replayable", "J17_track_state", "J18_tide_height", "W12_windows_below",
         "P17_way_verdict", "F28_F29_arc_cost", "G3_cost_distance", "R3_contour_segments", "W13_running_max", "T8_cpa_alarms", "T15_recorder_stream", "J16_compare_catalog", "W17_M8_update_state",
         "A10_infer_region", "W18_derived_heading", "S2_geojson_source", "X8_tile_cover_function", "F8_match_quality", "F9_fold_title", "O1_attribute_sort", "J8_signal_arcs", "J10_twin_arcs", "G2_crossings", "G4_routes", "G6_heading_penalty"]


@pytest.mark.parametrize("name", QUICK)
def test_matches_oracle(spark, duck, name):
    n, message = compare(spark, duck, "/root/testdata/sf0.001", name, QUERIES[name], ORACLES[name])
    assert message == "", message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
