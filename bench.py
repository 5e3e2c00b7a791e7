"""Benchmark: run the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line.

Each query runs to completion with the ``noop`` sink (full execution, nothing sent to the driver).  In the order of
HEADLINE, every query first runs once over the smallest tables beside $BENCH_SF_DIR, so that code is compiled, and
then over $BENCH_SF_DIR until RUNS times are taken or ENOUGH_S seconds spent; the median counts, ``spread`` has the least and
the greatest time, ``runs`` how many there were.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evalspark.plans.catalog import QUERIES  # noqa: E402
from evalspark.session import local_session  # noqa: E402

HEADLINE = [
    "rouge1",
    "rouge2",
    "rouge_l",
    "bleu",
    "meteor_exact",
    "score_matrix",
    "prompt_winners",
    "format_prompt",
    "status_map",
    "ready_evaluations",
    "classify_outcomes",
    "cosine",
    "scores",
    "score_all",
]
RUNS, ENOUGH_S = 5, 20


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="evalspark-bench")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times: dict[str, float] = {}
    spread: dict[str, list[float]] = {}
    runs: dict[str, int] = {}

    def run(name: str, folder: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:
        if os.path.isdir(small):
            run(name, small)
        own: list[float] = []
        while len(own) < RUNS and sum(own) < ENOUGH_S:
            own.append(run(name, sf_dir))
        times[name], spread[name], runs[name] = round(median(own), 3), [round(min(own), 3), round(max(own), 3)], len(own)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "spread": spread, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
