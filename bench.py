"""Seconds per query on one machine: prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose data, cores and repeats. Every
query is run to the end without collecting its rows; the figure is the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortlake.plans.queries import all_queries  # noqa: E402
from cohortlake.session import local_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    todo = {name: query for name, query in all_queries().items() if not only or name in only}
    seconds: dict[str, list[float]] = {name: [] for name in todo}
    for _ in range(runs):
        for name, query in todo.items():
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name].append(time.perf_counter() - start)
    medians = {name: round(statistics.median(times), 3) for name, times in seconds.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median seconds per query",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
