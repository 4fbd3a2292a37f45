"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridmeter.plans import catalog  # noqa: E402
from gridmeter.session import get_session, release_materialized  # noqa: E402

HEADLINE = [
    "clean_series", "clean_readings", "energy_conservation", "monthly_consumption", "acpu", "arpu",
    "revenue_slopes", "log_histogram", "boxplot_stats", "load_profile_ci", "voltage_histogram",
    "voltage_pf_density", "carbon_accounting", "resolve_site", "tariff_asof", "grid_losses",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", int(cpus) * 2)
    qs = catalog.queries()
    def run(n):
        t0 = time.perf_counter()
        try:
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - report and go on with the others
            print(f"bench: {n} failed: {str(e)[:300]}", file=sys.stderr)
            return None
        finally:
            release_materialized(spark)      # the query's scratch tables
        return round(time.perf_counter() - t0, 3)

    # pass 1 warms the JVM (JIT, generated code) and is reported as cold_total;
    # pass 2 is the measurement.  Each time covers plan building and execution.
    cold = {n: run(n) for n in names}
    times = {n: run(n) for n in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    ok = [v for v in times.values() if v is not None]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(ok), 3),
                      "unit": "sec", "queries": times, "sf": sf,
                      "cold_total": round(sum(v for v in cold.values() if v is not None), 3),
                      "failed": [n for n, v in times.items() if v is None]}))
    spark.stop()


if __name__ == "__main__":
    main()
