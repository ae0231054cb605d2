"""Times the headline queries and prints one JSON line.

Each query is warmed up once and then run BENCH_RUNS times; the figure is the median. All
rows are computed: the result goes to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillspark.plans import registry  # noqa: E402
from tillspark.session import build_session, clear_work  # noqa: E402

HEADLINE = (
    "period_totals", "category_comparison", "comparison_grouping_sets", "product_totals",
    "price_changes", "findings", "snapshot_hash", "archive_search", "receipt_detail",
    "pending_count", "current_state", "pull_page", "push_accept", "lww_winner",
    "status_transitions", "job_enqueue", "job_claim", "job_failure", "client_outcome",
    "extraction_rejects", "extraction_apply_receipts", "backfill", "content_store", "url_audit",
    "edit_receipts", "replace_items", "cascade_delete", "failure_limiter", "snapshot_verify",
    "stream_current_state", "stream_transitions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get(
        "BENCH_QUERIES") else HEADLINE
    conf = {"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.checkpoint.dir": os.environ.get("BENCH_WORK_DIR", "/tmp/tillspark-bench")}
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **conf)
    registered = registry.queries()
    timings = {}
    for name in wanted:
        taken = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        timings[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    clear_work(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
