"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query writes to the noop sink, so all rows and
columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plansift import catalog  # noqa: E402
from plansift.session import local_session  # noqa: E402

HEADLINE = [
    "j01_junction_graph", "w02_snap_walls", "w03_merge_collinear", "a06_classify_exterior", "a03_shell_coverage",
    "j04_best_wall", "f03_furniture_filter", "j07_nearest_midpoint_80", "w07_dedupe_openings", "w04_merge_spans",
    "a12_score_samples", "w11_stratified_split", "a19_class_iou", "m04_nearest_color", "m01_rasterize_walls",
    "j24_crawl_resume", "t05_take_until_target", "w13_best_and_early_stop", "j27_project_list", "r06_harvest_links",
    "m03_close_open", "m12_region_plan", "g06_footprint", "clean_walls_flow",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
