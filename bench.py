"""Times the headline queries and prints one JSON line.

Each query is built and fully executed (noop sink) on local[$BENCH_CPUS] over
$BENCH_SF_DIR, after one warm-up query. The reported time is the best of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from shopmetrics.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "net_sales_lines", "refund_reconciliation", "daily_sales_by_channel", "daily_conversion",
    "monthly_channel_conversion", "campaign_monthly", "revenue_summary", "revenue_sparklines", "revenue_trend",
    "revenue_trend_monthly", "revenue_by_channel", "yearly_comparison_months", "yearly_comparison_ytd",
    "top_products", "customer_summary", "rfm_scores", "rfm_segments", "top_customers", "acquisition_trend",
    "cohort_retention", "acquisition_channel_quality", "assign_row_numbers", "ntile_global",
    "resolve_discount_allocations", "anonymize_lines", "perturb_lines", "rederive_orders", "perturb_quantity",
    "term_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shopmetrics-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["revenue_summary"](spark, sf_dir).collect()
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
