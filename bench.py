"""Headline queries timed on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is written to the ``noop`` sink: one warm-up run, then the median of the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "aggregable_lines",
    "price_stats_levels",
    "price_stats_filtered",
    "stats_by_zone",
    "line_outliers",
    "price_grid",
    "price_grid_filtered",
    "site_fees",
    "quantity_threshold",
    "trend_lines_by_date",
    "cooccurrence",
    "category_rollup",
    "line_controls",
    "document_controls",
    "unit_normalization",
    "date_recovery",
    "rule_matching",
    "match_alternatives",
    "trigram_pairs",
    "embedding_pairs",
    "embedding_proposals",
    "item_search",
    "client_search",
    "bulk_validate",
    "undo_last",
    "progress_kpis",
    "item_queue",
    "orphan_queue",
    "history_lines",
    "ledger_state",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pricebase-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks.queries import REGISTRY

    def once(name: str) -> float:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
