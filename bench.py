"""Headline timings: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the
tables, the cores and the timed runs; each query has one warm-up, and its figure is the
median of the timed runs, written to Spark's noop sink."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lamina.plans.registry import QUERIES  # noqa: E402
from lamina.session import session  # noqa: E402

HEADLINE = (
    "pipeline_q6 pipeline_join_group filter_between filter_mask filter_count sel_intersect_bitmap sel_union_pos materialize_pos arith_mul sum_masked avg_all "
    "group_build group_lookup group_merge group_sum group_sum_masked join_unique join_first join_all sort_asc argsort_desc sort_clusters multi_sort"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(f"local[{cpus}]", spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "total median seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
