"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores and
BENCH_QUERIES an optional comma-separated choice of keys ("all" for every one).
Each time covers building and running a query, its results discarded by Spark's
noop sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from tillscope.plans.catalog import QUERIES
from tillscope.session import build_session

HEADLINE = (
    "csv_scan", "profile_columns", "cleaning_plan", "clean_sales", "kpi_pack", "kpi_panel", "category_panel",
    "period_change", "trend_facts", "kpi_cards", "holidays_near_points", "clip_outliers_by_group", "ffill_bfill",
    "fuzzy_match", "cosine_match", "seasonal_fit", "text_sections", "report_tables",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    keys = list(QUERIES) if chosen == "all" else (chosen.split(",") if chosen else list(HEADLINE))
    with tempfile.TemporaryDirectory(prefix="tillscope-bench-") as work:
        measure(folder, cpus, keys, work)


def measure(folder: str, cpus: str, keys: list[str], work: str) -> None:
    spark = build_session(
        "tillscope-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": work,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().write.format("noop").mode("overwrite").save()
    times, jobs = {}, {}
    tracker = spark.sparkContext.statusTracker()
    for key in keys:
        before = set(tracker.getJobIdsForGroup(None))
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        jobs[key] = len(set(tracker.getJobIdsForGroup(None)) - before)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "jobs": jobs,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
