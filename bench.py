"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line. Each query runs to completion through Spark's ``noop``
sink (the whole plan executes, nothing is collected to the driver).

One untimed pass over the headline queries warms the JVM (JIT, codegen
caches); the timed pass that follows measures steady-state time per query.
Set BENCH_WARMUP=0 to time cold runs instead."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labwave.plans.queries import QUERIES  # noqa: E402
from labwave.session import local_session  # noqa: E402

HEADLINE = [
    "attribute_samples", "time_bin_pivot", "matrix_join", "streak_flag", "value_delta",
    "dx_neutropenia", "dx_infection", "dx_hepatic", "dx_pancreatitis", "dx_delayed_elimination",
    "run_diagnostics", "patient_phenotype", "summary_detection", "melt_samples",
    "codebook_maps", "describe_columns", "key_containment", "chunk_text", "concat_group_text",
    "sql_adhoc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="labwave-bench")
    warm = names if os.environ.get("BENCH_WARMUP", "1") != "0" else ["sql_adhoc"]
    for name in warm:  # untimed
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
