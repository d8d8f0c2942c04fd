"""Time the headline queries: one warm-up, median of three. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from srcatlas.session import local_session  # noqa: E402

HEADLINE = [
    "match_sinks", "match_secrets_documents", "scan_findings", "resolve_calls", "entry_points", "graph_stats",
    "reachable", "number_findings", "write_sarif", "extract_calls", "extract_strings", "scan_inventory",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.sql.shuffle.partitions": cpus})
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}s (first {times[0]:.1f}s)", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, median seconds, summed", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
