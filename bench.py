"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores (default 8).
Each query is run once to warm up and then timed as the median of three full runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from coldledger.session import build_session  # noqa: E402
from registry.queries import registered  # noqa: E402

HEADLINE = (
    "index_job", "hotspots", "folder_rollup", "recursive_rollup", "newest_times", "aged_bytes_report",
    "resolve_owner", "file_manifest", "catalogue_lookup", "unarchived_hotspots", "verify_checksums",
    "store_listing", "archive_state", "archive_plan", "delete_plan", "restore_job", "tier_change_job", "prefix_size",
    "restore_status_counts", "small_file_plan", "bundle_small", "entitlements", "cost_report",
    "cascade_search_text", "idle_streak", "io_rates", "activity_windows")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
