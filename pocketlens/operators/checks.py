"""Data checks (the gold layer's schema tests) and dataset status.

Each table is checked in one aggregation: one ``count_if`` per test, then the
single row is unpivoted into (table_name, column_name, check_name, failures)
and the two tables' rows are unioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

# (table, column, check, accepted values or None for not_null), in declaration order.
FACT_CHECKS = [
    ("waterfall_fact", "country", "not_null", None),
    ("waterfall_fact", "year", "not_null", None),
    ("waterfall_fact", "year", "accepted_values", S.ACCEPTED_YEARS),
    ("waterfall_fact", "material", "not_null", None),
    ("waterfall_fact", "sold_to", "not_null", None),
    ("waterfall_fact", "pso", "not_null", None),
    ("waterfall_fact", "sales_qty", "not_null", None),
    ("waterfall_fact", "margin_pct", "not_null", None),
    ("waterfall_fact", "realization_pct", "not_null", None),
]
CUSTOMER_CHECKS = [
    ("customer_profitability", "sold_to", "not_null", None),
    ("customer_profitability", "margin_tier", "not_null", None),
    ("customer_profitability", "margin_tier", "accepted_values", S.TIER_LABELS),
    ("customer_profitability", "wavg_margin_pct", "not_null", None),
    ("customer_profitability", "total_qty", "not_null", None),
]

# Columns that the operators refuse to run without.
REQUIRED = {"waterfall": S.WATERFALL_REQUIRED, "period_metrics": S.PERIOD_REQUIRED, "outliers": S.OUTLIER_REQUIRED}


def _check_row(df: DataFrame, checks) -> DataFrame:
    entries = []
    for table, column, check, values in checks:
        c = F.col(column)
        failing = c.isNull() if values is None else ~c.isin(*values)  # NULL is not a failure of accepted_values
        entries.append(
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.lit(check).alias("check_name"),
                F.count_if(failing).alias("failures"),
            )
        )
    return df.agg(F.array(*entries).alias("_checks"))


def run_checks(fact: DataFrame, customers: DataFrame, years: list[int] | None = None) -> DataFrame:
    """14 checks: 12 not_null and 2 accepted_values, with failing-row counts.

    ``years`` are the accepted years of the fact table, ``schema.ACCEPTED_YEARS`` if not given.
    """
    accepted = S.ACCEPTED_YEARS if years is None else years
    fact_checks = [(*c[:3], accepted if c[1:3] == ("year", "accepted_values") else c[3]) for c in FACT_CHECKS]
    fact_rows = _check_row(fact, fact_checks).select(F.inline("_checks"))
    customer_rows = _check_row(customers, CUSTOMER_CHECKS).select(F.inline("_checks"))
    return fact_rows.unionByName(customer_rows)


def dataset_status(df: DataFrame, data_source: str) -> DataFrame:
    """Health row: status, data source label and row count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("ok").alias("status"), F.lit(data_source).alias("data_source"), "row_count"
    )


def coverage_by_year(df: DataFrame) -> DataFrame:
    """Rows, rows without a cost, and least and largest quantity by year.

    Counts and extremes only: over ``sources.footers.footer_table`` of a layer stored by year, no column is read.
    """
    counts = df.groupBy("year").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("standard_cost").alias("_costs"),
        F.min("sales_qty").alias("min_qty"),
        F.max("sales_qty").alias("max_qty"),
    )
    return counts.select("year", "row_count", (F.col("row_count") - F.col("_costs")).alias("rows_without_cost"), "min_qty", "max_qty")


def required_columns(df: DataFrame, required: dict[str, list[str]] = REQUIRED) -> DataFrame:
    """One row for each operator and column it needs: whether the table has the column, and its null rows.

    The columns are matched against the schema and counted in one aggregation of ``count(column)``,
    which ``sources.footers.footer_table`` answers from file footers.  A missing column has a null
    ``null_rows``.  :func:`functions.filters.require_columns` is the check that operators make themselves.
    """
    present = list(dict.fromkeys(c for columns in required.values() for c in columns if c in df.columns))
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in present])
    entries = [
        F.struct(
            F.lit(operator).alias("operator"),
            F.lit(c).alias("column_name"),
            F.lit(c in present).alias("present"),
            (F.col("_rows") - F.col(c) if c in present else F.lit(None)).cast("bigint").alias("null_rows"),
        )
        for operator, columns in required.items()
        for c in columns
    ]
    return counts.select(F.inline(F.array(*entries)))
