"""Time the headline queries. Each runs on its own from the source tables; results are computed in full.

Settings come from the environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES (comma-separated, or `all`).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cartflow.plans.queries import QUERIES
from cartflow.session import build_session, clear_scratch

HEADLINE = [
    "shop_orders",
    "order_items_enriched",
    "baskets",
    "profile_table",
    "fk_report",
    "kpi_summary",
    "top_products",
    "reorder_by_department",
    "training_baskets",
    "frequent_itemsets",
    "association_rules",
    "grid_metrics",
    "rule_names",
    "eval_contexts",
    "match_rules",
    "recommend_topk",
    "coverage_hits",
    "select_config",
    "recommend_baskets",
    "serve_baskets",
    "showcase_baskets",
    "product_itemsets",
    "product_recommend",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = build_session(
        "cartflow-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        clear_scratch(spark)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    report = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
