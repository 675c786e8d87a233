"""Time the headline queries and print one JSON line.

Inputs from $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]. Each query runs once to warm up and three times
timed; the median is reported. Results go to the noop sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from driftlock.queries import QUERIES
from driftlock.session import local_session

HEADLINE = {
    "b1_keyed_verify": "verify_lineitem_jn7",
    "b1_gate": "verify_unchanged_ag6",
    "b1_repeated_keys": "verify_repeated_keys_jn7",
    "b2_keyless_verify": "bag_diff_set2",
    "b3_cell_delta": "cell_delta_lk6",
    "b4_risk_ranking": "hotspots_sl1",
    "b5_lineage_scope": "change_scope_jn8",
    "b6_scrub": "scrub_documents_prj11",
    "b7_prove": "prove_score_lk14",
    "b8_generate": "one_hot_rows_gen6",
    "line_delta": "line_delta_lk4",
    "unified_diff": "unified_diff_lk5",
    "resolve_edges": "resolve_edges_jn1",
    "revenue_drift": "revenue_drift",
}


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "*"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for label, name in HEADLINE.items():
        seconds(spark, sf_dir, name)
        times[label] = round(statistics.median(seconds(spark, sf_dir, name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
