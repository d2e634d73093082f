"""Time and shuffled bytes of the pipeline's steps on generated rows: python tools/scale_run.py ROWS [OUT.json]

Writes the generated bronze rows once, then runs each step over the stored tables on local[$SCALE_CPUS].  ``dedup``
compares the library's map-side-combined arg-max with a two-phase one (newest load
by a hash aggregate of the keys, then a join and a tie-break) on rows with few repeats of a key.
Shuffled bytes come from Spark's event log, written next to the tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pocketlens.functions.quantiles import exact_percentiles  # noqa: E402
from pocketlens.operators.gold import waterfall_fact  # noqa: E402
from pocketlens.operators.outliers import detect_outliers  # noqa: E402
from pocketlens.operators.silver import DEDUP_ORDER, dedup_latest, silver_transactions, valid_base  # noqa: E402
from pocketlens.operators.waterfall import compute_waterfall  # noqa: E402
from pocketlens.schema import NATURAL_KEY  # noqa: E402
from pocketlens.session import local_session  # noqa: E402
from pocketlens.sources.files import write_layer  # noqa: E402
from pocketlens.sources.generate import generate_transactions  # noqa: E402


def two_phase(df: DataFrame) -> DataFrame:
    """The newest load of each key by hash aggregates, its rows by a join, and an arg-max only where loads tie."""
    counted = df.groupBy(*NATURAL_KEY, "_loaded_at").agg(F.count(F.lit(1)).alias("n"))
    stamp = F.unix_micros(F.col("_loaded_at").cast("timestamp")) * 2 + (F.col("n") > 1).cast("long")
    newest = counted.groupBy(*NATURAL_KEY).agg(F.max(stamp).alias("best"))
    rows = df.withColumn("at", F.unix_micros(F.col("_loaded_at").cast("timestamp")))
    newest = newest.withColumn("at", F.floor(F.col("best") / 2)).withColumn("tied", F.col("best") % 2 == 1).hint("shuffle_hash")
    met = rows.join(newest, [*NATURAL_KEY, "at"])
    order = [c for c in DEDUP_ORDER if c in df.columns]
    rest = [c for c in df.columns if c not in order and c not in NATURAL_KEY]
    tied = met.filter("tied").groupBy(*NATURAL_KEY).agg(F.max(F.struct(*order, *rest)).alias("b")).select(*NATURAL_KEY, "b.*")
    return met.filter("not tied").select(*df.columns).unionByName(tied.select(*df.columns))


def shuffled(log_dir: str) -> dict[str, float]:
    """MB written to shuffles by job description."""
    out: dict[str, float] = {}
    stage_of: dict[int, str] = {}
    for name in os.listdir(log_dir):
        with open(os.path.join(log_dir, name)) as lines:
            for line in lines:
                e = json.loads(line)
                if e["Event"] == "SparkListenerJobStart":
                    for stage in e["Stage IDs"]:
                        stage_of[stage] = (e.get("Properties") or {}).get("spark.job.description", "")
                elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                    step = stage_of.get(e["Stage ID"], "")
                    out[step] = out.get(step, 0) + e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] / 1e6
    return out


def main() -> None:
    rows, target = int(sys.argv[1]), sys.argv[2] if len(sys.argv) > 2 else None
    cpus = os.environ.get("SCALE_CPUS", "8")
    work = tempfile.mkdtemp(prefix="scale-run-")
    os.makedirs(f"{work}/events")
    os.environ["PYSPARK_SUBMIT_ARGS"] = (
        f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{work}/events --conf spark.eventLog.compress=false "
        f"--conf spark.eventLog.rolling.enabled=false --conf spark.checkpoint.dir=file://{work} pyspark-shell"
    )
    spark = local_session(cores=cpus, shuffle_partitions=64, app="scale-run")
    seconds: dict[str, float] = {}

    def step(name: str, run) -> None:
        spark.sparkContext.setJobDescription(name)
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 2)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)

    def forced(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    table = spark.read.parquet
    step("generate_bronze", lambda: write_layer(generate_transactions(spark, rows), f"{work}/bronze", layer="bronze"))
    bronze = table(f"{work}/bronze")
    # keys with one row in ten repeated, as the generator alone has some two thousand keys
    spread = bronze.withColumn("sold_to", F.concat("sold_to", F.lit("-"), F.pmod(F.xxhash64("sales_qty", "blue_jobber_price", "bonuses"), F.lit(rows * 4))))
    step("write_spread", lambda: spread.unionByName(spread.sample(0.1, 1).withColumn("_loaded_at", F.expr("_loaded_at + INTERVAL 1 DAY"))).write.parquet(f"{work}/spread"))
    valid = valid_base(table(f"{work}/spread"))
    for turn in (1, 2):
        step(f"dedup_arg_max_{turn}", lambda: forced(dedup_latest(valid)))
        step(f"dedup_two_phase_{turn}", lambda: forced(two_phase(valid)))
    step("build_silver", lambda: write_layer(silver_transactions(valid), f"{work}/silver", layer="silver"))
    silver = table(f"{work}/silver")
    step("build_fact", lambda: write_layer(waterfall_fact(silver), f"{work}/fact", layer="waterfall_fact"))
    step("compute_waterfall", lambda: forced(compute_waterfall(bronze)))
    step("percentiles_radix", lambda: forced(exact_percentiles(bronze, "sales_qty", [0.33, 0.67])))
    step("percentiles_builtin", lambda: forced(bronze.agg(F.percentile("sales_qty", F.array(F.lit(0.33), F.lit(0.67))))))
    step("detect_outliers", lambda: forced(detect_outliers(silver)))
    spark.sparkContext.setJobDescription("")
    counts = {"bronze": bronze.count(), "spread": valid.count(), "silver": silver.count()}
    same = dedup_latest(valid).exceptAll(two_phase(valid)).isEmpty() if rows <= 1_000_000 else None
    spark.stop()
    out = {"rows": rows, "cpus": int(cpus), "counts": counts, "seconds": seconds, "shuffle_mb": {k: round(v, 1) for k, v in shuffled(f"{work}/events").items() if k}}
    if same is not None:
        out["dedup_plans_agree"] = same
    print(json.dumps(out))
    if target:
        with open(target, "w") as f:
            json.dump(out, f, indent=1)


if __name__ == "__main__":
    main()
