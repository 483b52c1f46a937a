"""Benchmark the headline queries.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]``: one warm-up run, then the median of
``$BENCH_REPEAT`` (default 3) timed runs.  A run builds the plan and executes
it completely into the ``noop`` sink (no collect).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from chatloom.queries import QUERIES  # noqa: E402
from chatloom.session import get_session  # noqa: E402

HEADLINE = {
    "p6_capture_pipeline": "p6_capture_pipeline",
    "i12_prune_lowest": "i12_prune_lowest",
    "a1_training_stats": "a1_training_stats",
    "d3_build_dpo": "d3_build_dpo",
    "d9_split_train_val": "d9_split_train_val",
    "j2_similar_topk": "j2_similar_topk",
    "c2_deploy_gate": "c2_deploy_gate",
    "t5_trigger_points": "t5_trigger_points",
    "e2_score_pairs": "e2_score_pairs",
}


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [a for a in sys.argv[1:] if a in HEADLINE]
    spark = get_session(master=f"local[{cpus}]", partitions=int(cpus))
    results = {}
    for key, name in HEADLINE.items():
        if only and key not in only:
            continue
        run_once(spark, name, sf_dir)  # warm-up (JIT, Python workers, file listing)
        times = [run_once(spark, name, sf_dir) for _ in range(repeat)]
        results[key] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": sf,
        "master": f"local[{cpus}]",
        "repeat": repeat,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
