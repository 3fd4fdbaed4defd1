"""Benchmark: run the headline queries on one scale factor and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully executed with the ``noop`` sink (every row computed,
nothing collected to the driver), twice; the per-query figure is the faster
of the two runs (the first run also pays code generation and JIT for that
plan).  The value is the sum of the per-query figures.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from airwise.plans import catalog  # noqa: E402
from airwise.session import build_session  # noqa: E402

HEADLINE = [
    "fe_09_high_risk_outlook",
    "fe_09_high_risk_outlook_big",
    "fe_01_env_features_general",
    "fe_02_env_features_flare",
    "fe_03_user_time_features",
    "fe_04_jn_05_06_07_personal_enrichment",
    "wn_13_time_split",
    "jn_14_alerts",
    "jn_15_near_sensors",
    "ag_06_daily_grid_weather",
    "snk_04_upsert_merge",
    "ml_08_roc_auc",
    "sl_03_precision_at_k_outlook",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="airwise-bench")
    qs = catalog.RAW  # the query plans themselves (the registry's 6-dp rounding is for comparison only)
    # warm-up (not timed): JVM class loading, codegen caches, first parquet footers
    for name in ("lb_04_seed_rule", "fe_09_high_risk_outlook"):
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, first = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t0 = time.time()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        first[name] = round(runs[0], 3)
        times[name] = round(min(runs), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "first_run_total": round(sum(first.values()), 3)}))


if __name__ == "__main__":
    main()
