"""Wall-clock seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cadence.plans.catalog import QUERIES
from cadence.session import get_session, release

HEADLINE = (
    "quarterly_commits",
    "activity_panel",
    "label_activity",
    "score_distribution",
    "entity_activity_rate",
    "column_profile",
    "duplicate_rows",
    "fixed_sequences",
    "expanding_sequences",
    "history_stats",
    "forecast_ma3",
    "metrics_by_horizon",
    "best_so_far",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    release(spark)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
