"""Time every registered query; prints one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the local threads, BENCH_RUNS the
measured runs after one warm-up run (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from bellwether.plans.queries import QUERIES
from bellwether.session import build_session


def seconds(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        {"spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def measure(name: str) -> float:
        def run() -> None:
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()

        seconds(run)
        return statistics.median(seconds(run) for _ in range(runs))

    times = {name: round(measure(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds of all registered queries, warm",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
