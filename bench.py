"""Time every query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from corpusmatch.plans.queries import QUERIES
    from corpusmatch.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = set(sys.argv[1:])
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # start the JVM's and Python's machinery before the clock runs
    QUERIES["semantic_match"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, run in QUERIES.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    factor = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total time of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(factor.group(1)) if factor else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
