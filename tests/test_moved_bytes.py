"""What is shuffled and written more than once: joins of the line items, shared slices, layer writes; what stays on disk."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from pocketlens.functions.filters import TxnFilter
from pocketlens.operators import reports
from pocketlens.operators.silver import silver_transactions
from pocketlens.plans import catalog, layers
from pocketlens.session import scratch_path
from pocketlens.sources import adapter, batches, files
from pocketlens.sources.adapter import transactions_from_orders

from .conftest import SF_SMALL

BOUND = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "stored")
    transactions_from_orders(spark, SF_SMALL).write.parquet(path)
    return spark.read.parquet(path)


def same_rows(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_large_dimensions_do_not_shuffle_line_items_again(spark, stored):
    spark.conf.set(BOUND, "1k")  # no dimension can be broadcast, as in a large shop
    try:
        rows = transactions_from_orders(spark, SF_SMALL)
        joins = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
        assert "l_orderkey" in joins[0]  # the last join; orders have met their customers by then
        assert sum("l_orderkey" in j or "l_partkey" in j for j in joins) == 2
        assert same_rows(rows, stored)
    finally:
        spark.conf.unset(BOUND)


def test_small_dimensions_keep_the_chain(spark):
    plan = transactions_from_orders(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" in next(x for x in plan.splitlines() if "Join Inner" in x)


def test_append_and_batches_join_the_tables_once(spark, monkeypatch):
    read = []
    write, load = files.write_bronze, batches.BatchTable.load
    monkeypatch.setattr(files, "write_bronze", lambda df, *a, **k: (read.append(df.inputFiles()), write(df, *a, **k))[1])
    monkeypatch.setattr(batches.BatchTable, "load", lambda self, df, *a, **k: (read.append(df.inputFiles()), load(self, df, *a, **k))[1])
    n = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert catalog.QUERIES["bronze_table_append"](spark, SF_SMALL).count() == 2 * n
    assert [any("lineitem" in f for f in x) for x in read] == [True, False]
    read.clear()
    assert catalog.QUERIES["bronze_batch_table"](spark, SF_SMALL).count() == n
    assert len(read) == 3 and not any("lineitem" in f for x in read for f in x)


def test_slice_and_bridge_share_one_write(stored, monkeypatch):
    written = []
    shared = reports.shared
    monkeypatch.setattr(reports, "shared", lambda df, reuse: written.append(shared(df, reuse)) or written[-1])
    args = ("full_analysis", TxnFilter(pso="EUROPE"), 1999, 2000)
    once = reports.analyze(stored, *args, reuse="write")
    assert len(written) == 1 and "_loaded_at" not in written[0].columns
    assert set(once.bridge.inputFiles()) == set(written[0].inputFiles())
    assert once.payload.first() == reports.analyze(stored, *args).payload.first()
    assert same_rows(once.outliers, reports.analyze(stored, *args).outliers)


def test_slice_with_null_filter_values(stored):
    rows = stored.withColumn("pso", F.when(F.col("material") != "Brand#7", F.col("pso")))
    args = ("full_analysis", TxnFilter(pso="EUROPE"), 1999, 2000)
    assert reports.analyze(rows, *args, reuse="write").payload.first() == reports.analyze(rows, *args).payload.first()


def test_fact_is_written_from_clustered_silver(spark, stored, monkeypatch):
    calls = {}
    write = layers.write_layer
    monkeypatch.setattr(layers, "write_layer", lambda df, path, **k: (calls.update({k["layer"]: k}), write(df, path, **k))[1])
    built = layers.build_layers(spark, stored, scratch_path(spark, "layers"))
    assert {x for x, k in calls.items() if k["clustered"]} == {"waterfall_fact"}
    fact = built.tables["waterfall_fact"]
    assert "Exchange" not in files._laid_out(fact, ["year", "country"], True)._jdf.queryExecution().executedPlan().toString()
    for f in glob.glob(built.paths["waterfall_fact"].removeprefix("file:") + "/*/*.parquet"):
        countries = [r.country for r in spark.read.parquet(f"file://{f}").select("country").collect()]
        assert countries == sorted(countries)


def test_csv_compressed(spark, stored):
    path = scratch_path(spark, "csv")
    files.write_transactions_csv(stored, path, compression="gzip")
    assert glob.glob(path.removeprefix("file:") + "/*.csv.gz")
    assert same_rows(files.read_transactions_csv(spark, path), stored)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_layer_writes_leave_no_shuffle_files(spark, stored):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    path, held = scratch_path(spark, "released"), shuffle_files(spark)

    def left():
        for _ in range(40):  # files are removed in the background
            if not shuffle_files(spark) - held:
                return 0
            time.sleep(0.25)
        return len(shuffle_files(spark) - held)

    files.write_layer(silver_transactions(stored), path, layer="silver")
    assert left() == 0
    years = stored.filter("year = 1998").select("year").distinct()
    files.update_layer(silver_transactions(stored), path, years, "silver")
    assert left() == 0
    assert spark.conf.get(setting, None) == before


def test_parts_of_the_tables_make_the_whole(spark, stored, monkeypatch):
    assert len(adapter.transactions_in_parts(spark, SF_SMALL)) == 1
    monkeypatch.setattr(adapter, "PART_BYTES", 1)
    parts = adapter.transactions_in_parts(spark, SF_SMALL)
    counts = [p.count() for p in parts]
    assert len(parts) == adapter.MAX_PARTS and max(counts) < 0.4 * sum(counts)
    assert same_rows(files.write_rows_by_year(parts, scratch_path(spark, "parts")), stored)


def test_every_year_is_in_one_pass(spark):
    rows = spark.createDataFrame([(None,), (-3,), (0,), *((y,) for y in range(1990, 2030))], "year int")
    taken = [r.year for i in range(8) for r in files.year_pass(rows, i, 8).collect()]
    assert len(taken) == rows.count() and set(taken) == {r.year for r in rows.collect()}
    assert same_rows(files.year_pass(rows, 0, 1), rows)


@pytest.mark.parametrize("name", ["silver_layer_table", "customer_layer_refreshed"])
def test_large_layers_are_written_some_years_at_a_time(spark, monkeypatch, name):
    whole = catalog.QUERIES[name](spark, SF_SMALL)
    monkeypatch.setattr(adapter, "PART_BYTES", 1)
    monkeypatch.setattr(files, "PASS_BYTES", 1)
    seen = []
    write = layers.write_layer

    def watched(df, path, **k):
        if k["layer"] == "silver":
            seen.append({r.year for r in df.select("year").distinct().collect()})
        write(df, path, **k)

    monkeypatch.setattr(layers, "write_layer", watched)
    passes = catalog.QUERIES[name](spark, SF_SMALL)
    assert same_rows(passes, whole) and passes.columns == whole.columns
    assert len(seen) == files.MAX_PASSES and max(len(x) for x in seen) == 1
    assert sum(len(x) for x in seen) == len(set().union(*seen)) >= 6


def test_passes_keep_null_years_and_latest_rows(spark, stored):
    rows = stored.limit(200).unionByName(stored.limit(200).withColumn("year", F.lit(None).cast("int")))
    rows = rows.unionByName(rows)  # every row twice
    kept = files.write_rows_by_year([rows], scratch_path(spark, "odd"))
    path = scratch_path(spark, "odd-silver")
    layers.write_layer_in_passes(kept, silver_transactions, path, "silver", 3)
    want = silver_transactions(rows)
    got = spark.read.parquet(path).select(*want.columns)
    assert got.filter("year IS NULL").count() > 0 and same_rows(got, want)
