"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and once more; the second time counts. Results
go to the noop sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallyforge.queries import REGISTRY
from tallyforge.session import local_session

HEADLINE = [
    "prf4_duplicate_rows", "prf5_describe_numeric", "prf16_iqr_bounds", "prf18_dataset_health",
    "kpi3_role_totals", "kpi4_role_distinct", "trd2_period_growth", "trd5_linear_trend",
    "trd10_pct_change_spikes", "trd12_change_driver", "agg1_group_sum_rank", "agg4_concentration", "agg7_correlation_matrix",
    "anm3_rule_anomalies", "cht1_histogram",
    "prf12_inspect_dataset", "ml12_forecast_many", "cln5_clean_dataset",
    "qa7_top_n", "j4_latest_per_key", "u2_quota_check", "u4_rate_limit_exact", "txt2_language_purity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in only:
        fn = REGISTRY[name][0]
        best = None
        for attempt in range(2):
            start = time.perf_counter()
            fn(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
