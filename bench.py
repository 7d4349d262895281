"""Benchmark: headline queries on the star-schema tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is materialised with a no-op write (``noop`` format), so the whole
result is computed without collecting it to the driver.

Before timing, every headline query runs once on the smallest table set
(BENCH_WARM_DIR, default /root/testdata/sf0.001, skipped when absent) so JVM
JIT, whole-stage code generation caches and Python workers are warm; the
timed runs then measure steady-state work, which is what matters at scale.
No result or intermediate table is shared between the warm-up and the timed
runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketry import registry  # noqa: E402
from basketry.session import clear_materialized, local_session  # noqa: E402

HEADLINE = [
    "revenue_by_category",
    "sales_report",
    "customer_features",
    "standardized_features",
    "segment_assignment",
    "segment_profile_weighted",
    "user_item_matrix",
    "item_ranges",
    "recommend_popular",
    "recommend_batch",
    "evaluation_summary",
    "kmeans_segments",
    "elbow_series",
    "recommend_latent",
    "evaluation_latent",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for name in names:
            registry.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        clear_materialized(spark)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
