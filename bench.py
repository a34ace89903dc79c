"""Headline timings as one JSON line: a warm-up run, then the median of three."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "win_lagged_rolling_mean",
    "win_trailing_days_count",
    "jn_prev_event_rest",
    "pip_training_dataset",
    "pip_features",
    "pip_probability",
    "pip_request_features",
    "ml_batch_score",
    "ml_contributions",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    import registry
    from formline.session import local_session

    registry.load()
    spark = local_session(cpus, "formline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    times, first = {}, {}
    for name in only:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # The first run also builds the stage tables (and models) that later runs read.
        times[name], first[name] = round(statistics.median(runs[1:]), 3), round(runs[0], 3)
        print(f"{name}: {times[name]} (first {runs[0]:.2f})", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_runs": first,
                "sf": Path(sf_dir).name.removeprefix("sf"), "cores": cpus, "event_rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
