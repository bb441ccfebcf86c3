"""Headline queries timed end to end; prints one JSON line.

Scale and cores come from ``BENCH_SF_DIR`` and ``BENCH_CPUS``. Each query starts
from the Parquet tables, stages included, and is forced by a full write to the
``noop`` sink. One untimed warm-up query starts the JVM's code paths.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "average_trimmed", "customer_power", "signal_matrix", "customer_ranking", "top_suspects", "organisation_rollup",
    "transfer_candidates", "entities_against_peers", "rank_quality", "inspection_registry", "subtree_energy",
    "load_flow_balanced", "geographic_sectors", "work_orders", "journal_checks", "scenario_evaluation",
]


def main() -> None:
    from wattledger.registry import load
    from wattledger.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__sql__files__maxPartitionBytes="32m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    queries["semi_join_accounts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
