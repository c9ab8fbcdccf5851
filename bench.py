"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

REPO = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, REPO)

QUERIES = ["contract_detections", "gap_tracks", "promoted_events", "best_ious", "mean_average_precision", "split_distribution", "position_as_of", "near_points", "event_evidence", "key_violations"]


def main() -> None:
    from roadlake.plans import registry
    from roadlake.session import local_session, ship

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    known, times = registry.queries(), {}
    spark.read.parquet(f"{sf}/region.parquet").count()  # the session's start is not measured
    for name in QUERIES:
        runs = []
        for _ in range(2):  # the first run compiles; the faster is reported
            began = time.time()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
