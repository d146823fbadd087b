"""Bench: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each job (plan building + execution) is run to completion with the ``noop``
sink -- every row is computed, nothing is collected to the driver -- twice;
the faster run is reported per job (JIT-warm), the first-pass total is kept
as ``cold_total``. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rightsize.plans.jobs import JOBS  # noqa: E402
from rightsize.session import local_session  # noqa: E402

HEADLINE = ["calibrate", "wave_plan", "wave_fleet", "cost_estimate", "sla_search", "cheapest",
            "curve_gain", "profile_plan", "profile_compare", "profile_fleet", "node_pack",
            "pick_shape", "model_spread", "backtest_by_team", "domain_violations"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) * 2 if cpus != "*" else 16,
                          app_name="rightsize-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    runs = {name: [] for name in HEADLINE}
    for _ in range(2):
        for name in HEADLINE:
            t0 = time.perf_counter()
            JOBS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - t0)
    times = {name: round(min(r), 3) for name, r in runs.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "best_of": 2,
                      "cold_total": round(sum(r[0] for r in runs.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
