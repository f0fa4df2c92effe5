"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from commentguard.plans import inputs as inp  # noqa: E402
from commentguard.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "decisions_by_language", "t14_normalize_text", "m02_match_lexicon_join",
    "m02_match_lexicon_expressions", "m24_moderate_documents", "m24_moderate_events",
    "j05_moderate_distinct", "a03_class_metrics", "a07_metrics_by_language",
    "a14_validate_examples", "a19_cache_hits", "a21_fit_risk_weights",
    "a23_feedback_disagreement", "d05_stratified_split", "d07_uniquify_text",
    "m20_retrieve_rules", "r01_review_queue", "x04_windowed_decisions",
]
COMMENTS = {"m24_moderate_documents": "documents", "m24_moderate_events": "events"}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, cold, rates = {}, {}, {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        for seconds in (cold, times):  # the first run also compiles the plan
            started = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            seconds[name] = round(time.perf_counter() - started, 3)
        if name in COMMENTS:
            rates[name] = round(inp.table(spark, sf_dir, COMMENTS[name]).count() / times[name])
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "cold": cold, "comments_per_second": rates,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
