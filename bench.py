"""Time the headline queries and print one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyhound.plans.catalogue import QUERIES  # noqa: E402
from tallyhound.session import build_session  # noqa: E402

HEADLINE = [
    "r14a_invoice_header_vs_lines", "r14c_line_irregularities", "r25_triple_reconciliation", "win07_daily_balance",
    "r15c_quota_irregularities", "r01_exact_duplicates", "r03c_unlinked_refuel", "r05c_decrease_in_context", "ag01_daily_refuels",
    "r09s_refuels_close_in_time", "r12c_far_from_track", "r18c_double_charges", "jn10_optimal_match", "r13c_context_match",
    "ev01_metrics_by_type", "win12_effort_curve", "pf04_column_overview", "jn16_relations", "jn08_unlinked_causes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # the session's own start is not part of a query
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
