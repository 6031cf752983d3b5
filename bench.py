"""Times the headline queries: one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query, after one warm-up; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from thermoline.plans.queries import QUERIES  # noqa: E402
from thermoline.session import build_session  # noqa: E402

HEADLINE = (
    "a1_avg_by_group", "a2_alert_counts", "a3_alert_hours", "a4_fleet_summary",
    "a9_partition_catalog", "a12_top_overheating", "c3_impute_reading", "c5_normalize_timestamp",
    "f2_filter_readings", "f3_history", "f4_keep_valid_machines_strict", "j1_outer_merge",
    "j2_status_with_predictions", "k3_insights_snapshot", "k5_upsert_status", "k6_merge_by_key",
    "k8_sync_partitions", "m1_label_next_breach", "m4_train", "m5_labelled_counts",
    "m8_score_with_coefficients", "o1_newest", "s3_load_history", "s5_decode_records",
    "t1_telemetry_stream", "t2_fan_out_status", "u1_recent_telemetry", "u1_newest_first",
    "u2_dedupe", "w1_with_next", "w2_latest_per_key",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
