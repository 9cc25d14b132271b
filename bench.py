"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is timed from its DataFrame to a complete run of all its columns
(a no-op write); the better of $BENCH_ROUNDS runs counts, so that loading the
engine's classes is not charged to whichever query comes first.  Chart queries
read written fact tables, which their first run writes.
"""

from __future__ import annotations

import json
import os
import sys
import time

from merchantry.session import build_session
from merchantry.workloads import building_blocks as blocks, queries as workloads

HEADLINE = [
    "fct_orders",
    "dim_customers",
    "fct_cin7_sales",
    "dim_customer_unified",
    "fct_b2b_sales",
    "fct_product_sales",
    "fct_product_pairs",
    "fct_product_repeat_rate",
    "fct_klaviyo_revenue",
    "fct_klaviyo_campaign_revenue",
    "fct_campaign_performance",
    "fct_klaviyo_subscriber_growth",
    "fct_ad_spend",
    "fct_ga_source_medium",
    "fct_brand_monthly_summary",
    "fct_marketing_kpis_daily",
    "fct_google_ads_search_terms",
    "latest_line_per_key",
    "last_touch_5d",
    "order_seq_per_customer",
    "part_pairs",
    "spine_daily_kpis",
    "topk_customers",
    "metrics_fct_orders",
    "chart_customer_mix_aov_split",
    "chart_top_products_by_revenue",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = workloads.queries()
    wanted = sys.argv[1:] or HEADLINE
    blocks.Tables(spark, folder).orders.count()  # starts the engine before the clock
    seconds = {}
    for name in wanted:
        runs = []
        for _ in range(rounds):
            workloads.forget()  # else a second run would find sorted rows that the first one wrote
            start = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
