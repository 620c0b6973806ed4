"""Benchmark the headline queries.

Runs each query to completion with the ``noop`` sink (full execution, no
driver collect) on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1).  One warm-up pass over all queries, then
the median of ``$BENCH_RUNS`` (default 3) timed runs per query.  Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from ledgerlens.plans.registry import QUERIES  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402

HEADLINE = [
    "feature_matrix", "kpi_change", "describe_features", "granger_lag1", "cost_elasticity",
    "forecast_daily", "daily_features", "topsis_rank", "chunk_text", "hybrid_rerank", "extractive_answer",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})

    def once(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for n in names:
        once(n)
    times = {n: round(statistics.median(once(n) for _ in range(runs)), 3) for n in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
