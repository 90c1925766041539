"""Wall time of headline queries over the driver tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "co_mention_links", "network_nodes", "neighbours", "recalculate_risk", "refresh_linked",
    "history_snapshot", "distinct_signals", "upsert_links", "upsert_subjects", "failure_state",
    "fetch_latency", "investigation_rollup", "admit_reports", "assemble_reports", "canonical_urls",
    "text_screens", "flag_repetitive", "drop_near_duplicates", "select_candidates", "select_targets",
    "baseline_summaries", "fallback_verdict", "main_text", "search_results", "post_evidence",
    "blacklist_records", "ingest_investigations", "score_with",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from riskgraph.plans.checks import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "riskgraph_headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
