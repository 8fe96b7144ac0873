"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to the no-op sink, so all rows and columns are produced. The
value per query is the median of $BENCH_RUNS runs after one warm-up query.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from ledgerloom.plans.catalog import QUERIES
from ledgerloom.session import local_session

HEADLINE = [
    "month_totals", "month_over_month", "category_breakdown", "daily_spending", "day_groups",
    "recent_by_month", "day_sorted_entries", "ledger_search", "ledger_filter_all", "by_source_semi",
    "count_by_source", "txn_detail", "apply_edits", "audit_unique", "norm_reference", "fingerprints",
    "alerts_extract", "score", "statement_rows", "statement_text", "resolve_outcomes",
    "resolved_ledger", "rescore", "stream_ingest",
]


def run(spark, name: str, directory: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "ledgerloom-bench")
    run(spark, "month_totals", directory)
    seconds = {
        name: round(statistics.median(run(spark, name, directory) for _ in range(runs)), 3)
        for name in HEADLINE
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "ledger_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
