"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data set and ``BENCH_CPUS`` the number of local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from beaconlake.plans.capture import beacons, frames  # noqa: E402
from beaconlake.plans.catalog import CATALOG  # noqa: E402
from beaconlake.session import job_scope, local_session  # noqa: E402

HEADLINES = [
    "clock_skew", "timing_variance", "seq_duplicate", "frame_observations", "scanned_networks",
    "network_inventory", "scan_windows", "collection_summary", "ap_profiles", "deviations",
    "frame_evidence", "suspicious_streaks", "alerts", "stream_alerts", "skew_distribution",
    "scrub_text", "scrub_documents", "mac_audit", "median_impute", "stratified_counts",
    "classification_report", "forest_scores", "forest_global", "forest_classifier",
]
REPEAT_BELOW = 15.0


def run(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()

    # The fixture is built first and reported apart.
    fixture = {
        "beacons_table": run(lambda: beacons(spark, data_dir)),
        "frames_table": run(lambda: frames(spark, data_dir)),
    }
    seconds = {}
    for name in HEADLINES:
        def execute() -> None:
            with job_scope(spark):
                CATALOG[name](spark, data_dir).write.format("noop").mode("overwrite").save()

        taken = run(execute)
        # Short queries are repeated once, so that compilation does not dominate.
        seconds[name] = min(taken, run(execute)) if taken < REPEAT_BELOW else taken
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "fixture": {name: round(value, 3) for name, value in fixture.items()},
                "sf": os.path.basename(data_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
