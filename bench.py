"""Benchmark on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Runs the way the library is deployed: the medallion layers are built once and
written as tables (bronze from the driver tables through the adapter, then the
deduplicated silver layer and the gold fact, range-partitioned by year), and
the headline queries then read those tables.  Every step is forced with the
``noop`` sink or a table write, so all rows are computed and nothing is
collected.  Build steps are reported as ``build_*``; ``value`` is the sum of all
steps.  Tables go to a fresh folder under the session's checkpoint directory.

Before timing, the same pipeline and queries run once, untimed, over the
smallest test tables (``$BENCH_WARMUP_DIR``, default sf0.001) so JIT and
code generation are warm; that pass is reported as ``warmup_sec``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "customer_profitability",
    "waterfall_alerts",
    "data_checks",
    "compute_waterfall",
    "waterfall_by_segment",
    "waterfall_steps",
    "period_metrics",
    "margin_bridge",
    "volume_bands",
    "detect_outliers",
    "top_outliers",
    "readonly_sql",
    "q_margin_by_country",
    "q_top_customers_revenue",
    "q_low_tier_groups",
    "q_outlier_customers",
    "q_full_analysis",
]


def _timed(times: dict, name: str, fn) -> None:
    t0 = time.perf_counter()
    fn()
    times[name] = round(time.perf_counter() - t0, 3)


def run_pipeline(spark, sf_dir: str, names: list[str]) -> dict[str, float]:
    from pocketlens.operators.gold import waterfall_fact
    from pocketlens.operators.silver import silver_transactions
    from pocketlens.plans.catalog import LAYER_QUERIES, Layers
    from pocketlens.session import scratch_path
    from pocketlens.sources.adapter import transactions_from_orders
    from pocketlens.sources.files import write_layer

    root = scratch_path(spark, "bench-layers")
    paths = {k: f"{root}/{k}" for k in ("bronze", "silver", "fact")}
    times: dict[str, float] = {}
    _timed(times, "build_bronze", lambda: write_layer(transactions_from_orders(spark, sf_dir), paths["bronze"], layer="bronze"))
    bronze = spark.read.parquet(paths["bronze"])
    _timed(times, "build_silver", lambda: write_layer(silver_transactions(bronze), paths["silver"], layer="silver"))
    silver = spark.read.parquet(paths["silver"])
    _timed(times, "build_fact", lambda: write_layer(waterfall_fact(silver), paths["fact"], layer="waterfall_fact"))

    for name in names:
        def run(name=name):
            LAYER_QUERIES[name](Layers(spark, sf_dir, paths)).write.format("noop").mode("overwrite").save()

        _timed(times, name, run)
        spark.catalog.clearCache()
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from pocketlens.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2), app="pocketlens-bench")
    t0 = time.perf_counter()
    if os.path.isdir(warm_dir):
        run_pipeline(spark, warm_dir, names)
    warmup = round(time.perf_counter() - t0, 3)

    times = run_pipeline(spark, sf_dir, names)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "warmup_sec": warmup,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
