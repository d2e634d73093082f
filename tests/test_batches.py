"""Bronze loads by batch, decimals at rest, and layers brought up to date by year."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pocketlens.plans.layers import build_layers, refresh_layers
from pocketlens.session import scratch_path
from pocketlens.sources.adapter import transactions_from_orders
from pocketlens.sources.batches import BatchTable, at_rest

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def bronze(spark):
    path = scratch_path(spark, "bronze-test")
    transactions_from_orders(spark, SF_SMALL).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def table(spark):
    return BatchTable(spark, scratch_path(spark, "batches"))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_batch_is_appended_once(spark, bronze, table):
    old, new = bronze.filter("year < 1998"), bronze.filter("year >= 1998")
    first = table.load(old, "a")
    assert first.appended and first.rows == old.count() == table.row_count()
    assert table.load(new, "b").appended
    again = table.load(new, "b")
    assert not again.appended and again.rows == new.count()
    assert table.row_count() == bronze.count() and rows_of(table.read()) == rows_of(bronze)
    assert [e["batch"] for e in table.batches()] == ["a", "b"]


def test_a_failed_load_leaves_nothing(spark, bronze, table):
    table.load(bronze.limit(10), "a")
    broken = bronze.withColumn("sales_qty", F.when(F.col("year") == 1999, F.raise_error(F.lit("torn off"))).otherwise(F.col("sales_qty")))
    with pytest.raises(Exception, match="torn off"):
        table.load(broken, "b")
    assert table.row_count() == 10 == table.read().count()
    assert table.load(bronze, "b").appended and table.row_count() == 10 + bronze.count()


def test_a_taken_log_number_is_tried_again_and_a_faster_attempt_wins(spark, bronze, table):
    table.load(bronze.limit(3), "a")
    other = BatchTable(spark, table.path)
    real, calls = table._log, []

    def late():
        """The log as it was before another loader committed, at first."""
        calls.append(1)
        if len(calls) == 2:
            stale = real()
            other.load(bronze.limit(4), "b")
            return stale
        return real()

    table._log = late
    assert table.load(bronze.limit(5), "c").appended
    assert [e["batch"] for e in real()] == ["a", "b", "c"] and table.row_count() == 12
    calls.clear()

    def beaten():
        calls.append(1)
        if len(calls) == 1:
            seen = real()
            other.load(bronze.limit(2), "d")
            return seen
        return real()

    table._log = beaten
    lost = table.load(bronze.limit(6), "d")
    assert not lost.appended and lost.rows == 2 and other.row_count() == 14


def test_truncate_empty_batches_and_bad_ids(spark, bronze, table):
    assert table.read().count() == 0 and table.row_count() == 0
    table.load(bronze.limit(9), "a")
    table.load(bronze.limit(4), "b", truncate=True)
    assert table.row_count() == 4 == table.read().count()
    assert not table.load(bronze, "a").appended  # behind the truncation, but loaded once
    assert table.load(bronze.limit(0), "none").appended and table.row_count() == 4
    for bad in ("", "a/b", "../x", "x" * 101):
        with pytest.raises(ValueError):
            table.load(bronze, bad)


def test_decimals_at_rest(spark, bronze, table):
    table.load(bronze, "a")
    folder = f"{table.path}/{table.batches()[0]['folder']}"
    stored = spark.read.parquet(folder)
    measures = [f.name for f in stored.schema if f.dataType == T.DecimalType(18, 4)]
    assert len(measures) == 8 and "sales_qty" in measures and "standard_cost" in measures
    assert rows_of(table.read()) == rows_of(bronze)  # the same doubles come back
    for value in (1e14, -1e14, float("nan"), float("inf")):
        with pytest.raises(Exception, match="pocket_price does not fit decimal"):
            at_rest(bronze.limit(1).withColumn("pocket_price", F.lit(value))).collect()
    edge = at_rest(bronze.limit(1).withColumn("pocket_price", F.lit(99999999999999.0)).withColumn("material_cost", F.lit(None).cast("double")))
    assert str(edge.first().pocket_price) == "99999999999999.0000" and edge.first().material_cost is None


def files_by_year(path):
    out = {}
    for folder, _, names in os.walk(path.removeprefix("file:")):
        for name in names:
            if name.endswith(".parquet"):
                out.setdefault(os.path.basename(folder), {})[name] = os.stat(f"{folder}/{name}").st_mtime_ns
    return out


def test_a_new_year_rewrites_one_year(spark, bronze):
    root = scratch_path(spark, "layers")
    old = bronze.filter("year < 2000 OR (year = 2000 AND sold_to < 'Customer#00005')")
    new = bronze.exceptAll(old)
    assert new.select("year").distinct().count() >= 1
    built = build_layers(spark, old, root)
    before = {layer: files_by_year(built.paths[layer]) for layer in ("silver", "waterfall_fact", "customer_profitability")}
    refreshed = refresh_layers(built, bronze, new)
    years = {f"year={r.year}" for r in new.select("year").distinct().collect()}
    for layer, files in before.items():
        after = files_by_year(refreshed.paths[layer])
        for year, names in files.items():
            assert (after[year] == names) == (year not in years), (layer, year)
    whole = build_layers(spark, bronze, scratch_path(spark, "layers"))
    for layer, df in whole.tables.items():
        columns = [c for c in df.columns if c != "detected_at"]
        assert rows_of(refreshed.tables[layer].select(*columns)) == rows_of(df.select(*columns)), layer


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_clustered_layers_skip_row_groups_and_years(spark, bronze):
    """A filter on a sort key reads no row group without the value, one on the year no other year's files."""
    built = build_layers(spark, bronze, scratch_path(spark, "layers"), layers=("silver",))
    silver = refresh_layers(built, bronze, bronze.filter("year = 1997")).tables["silver"]
    assert rows_scanned(silver.filter("country = 'NATION_7x'")) == 0  # between NATION_7 and NATION_8
    whole, year = silver.count(), silver.filter("year = 1997").count()
    assert rows_scanned(silver.filter("year = 1997")) == year < whole
    assert rows_scanned(silver.filter("country = 'NATION_7'")) < whole + 1
