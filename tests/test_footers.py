"""Counts from file footers, accepted years, required columns, and row groups that filters skip."""

import pytest
from pyspark.sql import functions as F

from pocketlens import schema as S
from pocketlens.operators import checks
from pocketlens.sources.files import write_layer
from pocketlens.sources.footers import V1_SOURCES, footer_table

from .test_layers import row


@pytest.fixture
def stored(df_of, tmp_path):
    rows = [row(sales_qty=q, year=2023 + q % 3, standard_cost=None if q == 5 else 50.0) for q in range(1, 12)]
    write_layer(df_of(rows), f"{tmp_path}/bronze", layer="bronze")
    return f"{tmp_path}/bronze"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_status_and_coverage_read_no_column(spark, stored):
    before = spark.conf.get(V1_SOURCES)
    table = footer_table(spark, stored)
    status, coverage = checks.dataset_status(table, "bronze"), checks.coverage_by_year(table)
    assert "COUNT(*)" in plan_of(status) and "PushedAggregation: [COUNT(*)]" in plan_of(status)
    assert "PushedGroupBy: [year]" in plan_of(coverage) and "MAX(sales_qty)" in plan_of(coverage)
    assert tuple(status.first()) == ("ok", "bronze", 11)
    plain = checks.coverage_by_year(spark.read.parquet(stored))
    assert sorted(map(tuple, coverage.collect())) == sorted(map(tuple, plain.collect()))
    assert sorted((r.year, r.row_count, r.rows_without_cost, r.min_qty, r.max_qty) for r in coverage.collect()) == [
        (2023, 3, 0, 3.0, 9.0), (2024, 4, 0, 1.0, 10.0), (2025, 4, 1, 2.0, 11.0),
    ]
    assert spark.conf.get(V1_SOURCES) == before  # the caller's session is as it was


def test_required_columns(spark, stored):
    table = footer_table(spark, stored)
    report = checks.required_columns(table)
    assert "PushedAggregation: [COUNT(*), COUNT(sales_qty)" in plan_of(report)
    rows = {(r.operator, r.column_name): (r.present, r.null_rows) for r in report.collect()}
    assert len(rows) == len(S.WATERFALL_REQUIRED) + len(S.PERIOD_REQUIRED) + len(S.OUTLIER_REQUIRED)
    assert rows[("waterfall", "standard_cost")] == (True, 1) and rows[("outliers", "year")] == (True, 0)
    lacking = {(r.operator, r.column_name): (r.present, r.null_rows) for r in checks.required_columns(table.drop("bonuses", "pso")).collect()}
    assert {k for k, v in lacking.items() if v == (False, None)} == {
        ("waterfall", "bonuses"), ("period_metrics", "bonuses"), ("outliers", "bonuses"), ("outliers", "pso"),
    }


def test_an_empty_table(spark, df_of, tmp_path):
    write_layer(df_of([row()]).filter("false"), f"{tmp_path}/none", layer="bronze")
    plain = spark.createDataFrame([], df_of([row()]).schema)
    assert checks.dataset_status(plain, "none").first().row_count == 0
    assert checks.coverage_by_year(plain).count() == 0
    assert {r.null_rows for r in checks.required_columns(plain).collect()} == {0}


def test_accepted_years_are_an_argument(spark, df_of):
    from pocketlens.operators.gold import customer_profitability, waterfall_fact
    from pocketlens.operators.silver import silver_transactions

    fact = waterfall_fact(silver_transactions(df_of([row(year=1996), row(year=1997), row(year=2025)])))

    def failures(*years):
        rows = checks.run_checks(fact, customer_profitability(fact), *years).collect()
        assert len(rows) == 14
        return {r.failures for r in rows if r.check_name == "accepted_values" and r.column_name == "year"}

    assert failures() == {2} and failures([1996, 1997]) == {1} and failures([1996, 1997, 2025]) == {0}


def scanned(spark, df):
    """(rows of ``df``, rows that its scan handed on, before the filter)."""
    plan = df._jdf.queryExecution()
    n = plan.toRdd().count()
    scan = plan.executedPlan()
    while not scan.children().isEmpty():
        scan = scan.children().head()
    return n, scan.metrics().apply("numOutputRows").value()


def test_filters_skip_row_groups(spark, tmp_path):
    """Row groups of a few hundred rows: a country is found by statistics, a customer by Bloom filter."""
    n = 40_000
    rows = spark.range(n).select(
        F.format_string("C%02d", F.col("id") % 20).alias("country"),
        F.lit(2024).alias("year"),
        F.concat(F.lit("customer-"), F.xxhash64("id").cast("string")).alias("sold_to"),
        F.col("id").cast("double").alias("sales_qty"),
    )
    path = f"{tmp_path}/layer"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    hadoop = spark._jsc.hadoopConfiguration()
    small = {"parquet.block.size": "16384", "parquet.page.size.row.check.min": "100", "parquet.block.size.row.check.min": "100", "parquet.enable.dictionary": "false"}
    for k, v in small.items():
        hadoop.set(k, v)
    try:
        write_layer(rows.coalesce(1), path, layer="bronze")
        table = spark.read.parquet(path)
        found, read = scanned(spark, table.filter("country = 'C07'"))
        assert found == n // 20 and read < n // 4
        one = rows.filter("id = 777").first().sold_to
        found, read = scanned(spark, table.filter(F.col("sold_to") == one))
        assert found == 1 and read < n // 4
        without = spark.read.option("parquet.filter.bloom.enabled", "false").parquet(path)
        found, read = scanned(spark, without.filter(F.col("sold_to") == one))
        assert found == 1 and read == n  # the value lies between the extremes of every row group
    finally:
        for k in small:
            hadoop.unset(k)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
