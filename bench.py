"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local threads. Every query runs to the end (into a sink that drops the
rows); each is run twice and the second run counts, so that the start of the
JVM and of the Python workers is left out.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagetab.plans.queries import QUERIES, forget_runs  # noqa: E402

HEADLINE = (
    "page_text", "links", "links_resolved", "normalize_url", "classify_response", "robots_blocked", "first_seen",
    "candidate_cap", "decode_bodies", "clean_text", "manifest_reconcile", "request_gaps", "frontier_depth", "chain_depth",
    "crawl_records", "run_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pagetab-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            forget_runs()
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    reached = QUERIES["crawl_records"](spark, sf_dir).count()
    print(json.dumps({
        "metric": "total seconds of the headline queries, second run each",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "pages": pages,
        "page_text_pages_per_second": round(pages / seconds["page_text"], 1),
        "crawl_records": reached,
        "crawl_records_per_second": round(reached / seconds["crawl_records"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
