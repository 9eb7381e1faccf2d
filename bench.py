"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from behavior_spark.session import get_session

HEADLINE = (
    "event_scan",
    "normalize_events",
    "purchase_items",
    "orders_latest",
    "live_session_features",
    "dataset_session_features",
    "rule_scores",
    "lead_funnel",
    "top_leads",
    "heatmap_click",
    "heatmap_scroll",
    "density_grid",
    "session_stats",
    "click_ranking",
    "item_latest",
    "category_coverage",
    "running_max_scroll",
    "mousemove_throttle",
    "cart_value",
    "consent_gate",
    "validate_events",
    "rule_roc_auc",
    "stratified_split",
    "stream_events",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from behavior_spark.plans.catalog import QUERIES

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in wanted:
        run(name)  # first run: code generation and file listing
        seconds[name] = round(min(run(name) for _ in range(2)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
