"""Times the headline queries on ``$BENCH_SF_DIR`` and prints one JSON line.

Every query runs in full to a sink that discards its rows; nothing is kept from one
query to the next.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.all_queries import QUERIES  # noqa: E402
from checks.session import local_session  # noqa: E402

HEADLINE = (
    "C20_model_frame", "C21_prepare", "C22_prepare_for_model", "C18_customer_purchase_count",
    "P1_quality_summary", "P3_column_profile",
    "A1_top_product", "A2_top_entities_product", "A3_top_customers", "A4_customer_kpis",
    "A6_revenue_drivers", "A9_concentration", "A11_sales_trend_weekly", "A16_histograms",
    "A17_densities", "A21_segment_category_top_product", "A22_product_dimension",
    "M7_baseline_metrics", "M10_train_leaderboard",
    "T2_route_dashboard", "T7_scenarios_dashboard", "T9_answers",
    "IO4_discover_links", "IO11_report_tables",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session()
    # Start the executor threads and compile the common code before the first clock.
    for name in ("A1_top_region", "P1_imputations"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
