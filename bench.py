"""Time the named queries and print one JSON line.

BENCH_SF_DIR   tables to read                      (default /root/testdata/sf0.1)
BENCH_CPUS     local cores                         (default: all)
BENCH_RUNS     timed runs after one warm-up run    (default 3; the median counts)
BENCH_QUERIES  comma-separated names               (default: HEADLINE; 'all' for every query)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_frame",
    "stored_split",
    "value_counts",
    "distinct_with_null",
    "profile",
    "scale_minmax",
    "split_keyed",
    "flatten_pages",
    "stream_upsert",
    "audit_constraints",
    "range_breakdown",
    "range_breakdown_skewed",
    "count_per_period",
    "assign_periods",
    "page_number",
    "upsert_latest",
    "dedup_by_key",
    "headings_all",
    "token_counts",
    "bag_of_words",
    "bigrams",
    "vocab_filtered",
    "lemma_bags",
    "tfidf",
    "leaderboard",
]


def main() -> None:
    from limelight import catalogue
    from limelight.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = catalogue.runnable()
    names = list(queries) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)

    spark = local_session(cores, shuffle_partitions=int(cores), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name:28s} {seconds[name]:8.3f}  first {times[0]:.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
