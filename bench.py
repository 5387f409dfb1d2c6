"""Wall time of the headline queries; prints one JSON line.

Each query is run once to warm up and then three times; the median counts.
Results go to a sink that discards them, so the time is that of the query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from perilgrid.catalog import all_queries  # noqa: E402
from perilgrid.session import local_session  # noqa: E402

HEADLINE = [
    "p07_prediction_cycle",
    "v03_valid_rows",
    "v07_prediction_contract",
    "h01_feed_gaps",
    "w01_last_readings",
    "w05_report_bursts",
    "w06_blockage_debounce",
    "f11_graph_propagation",
    "f14_image_features",
    "x05_explanation_records",
    "a01_subscribers",
    "a05_alert_records",
    "a06_infrastructure_alerts",
    "c01_report_region",
    "q01_region_board",
    "q05_predicted_vs_actual",
    "q06_accuracy",
    "q07_seasonal_pattern",
    "t06_answers",
    "t02_region_mention",
    "k02_insert_if_absent",
    "r04_shortest_paths",
    "r05_route_records",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
