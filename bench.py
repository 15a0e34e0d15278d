"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pricelattice.registry import QUERIES
from pricelattice.session import get_session

HEADLINE = [
    "latest_price", "best_deals", "best_deals_lineitem", "category_index", "heatmap", "ingest_metrics", "compare_products", "spike", "past_similar_spike",
    "manipulation", "cyclic", "full_detection", "anomaly_dedup", "product_features", "fx_sensitivity", "alerts", "product_change_log", "product_upsert", "forecasts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", cpus)
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(2):  # the second run finds its code compiled
            spark.catalog.clearCache()
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
