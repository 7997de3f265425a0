"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import tempfile
import time

HEADLINE = ["P2_select_where", "P3_saved_queries", "A4_quantiles_real", "J1_coverage_overlap", "J3_nearest_node", "O2_O3_W16_search", "W1_speed", "W3_drop_non_monotonic",
            "A14_path_lengths", "J17_track_state", "J18_tide_height", "W12_windows_below", "F28_F29_arc_cost", "G3_cost_distance", "R3_contour_segments", "R5_hillshade",
            "R8_viewshed", "A12_chart_names", "G1_road_graph", "G9_beaches", "J15_area_walk", "M7_apply_updates", "R4_contour_lines", "F22_J24_cpa", "T8_cpa_alarms", "J16_compare_catalog", "W17_M8_update_state", "A9_zoom_extent"]


def main() -> None:
    from geolattice.plans import QUERIES
    from geolattice.session import build
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    QUERIES["A9_zoom_extent"](spark, sf).write.format("noop").mode("overwrite").save()   # warm-up
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
