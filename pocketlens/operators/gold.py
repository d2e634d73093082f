"""Gold layer: per-transaction fact, customer profitability, segment alerts.

All three are single projections or single ``groupBy().agg()`` steps, so each
costs one partial/final aggregation (a shuffle of at most one row per group per
map task).  Money totals are exact decimal sums (order independent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import alert_severity, alert_type, margin_tier, severity_rank
from ..functions.filters import TxnFilter, apply_filters
from ..functions.ratios import ratio_columns
from ..functions.rounding import exact_ratio, exact_sum, round_half_up

FACT_DIMENSIONS = ["country", "year", "material", "sales_designation", "sold_to", "corporate_group", "pso"]
FACT_BASE = [
    "sales_qty",
    "blue_jobber_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "standard_cost",
    "material_cost",
]
FACT_RATIOS = ["margin_pct", "deduction_pct", "bonus_pct", "realization_pct", "leakage_pct"]
CUSTOMER_KEYS = ["sold_to", "corporate_group", "country", "pso", "year"]
SEGMENT_KEYS = ["country", "pso", "year"]

# Projection of the parameterised fact query (21 columns).
FACT_SLICE_COLUMNS = [
    "country",
    "year",
    "material",
    "sales_designation",
    "sold_to",
    "corporate_group",
    "pso",
    "sales_qty",
    "blue_jobber_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "standard_cost",
    "material_cost",
    "contribution_margin",
    "margin_pct",
    "deduction_pct",
    "bonus_pct",
    "realization_pct",
    "leakage_pct",
]


def waterfall_fact(silver: DataFrame) -> DataFrame:
    """One row per valid transaction plus nine derived measures.

    Ratios use the NULL guard and are rounded to 2 dp.
    """
    qty, pocket, std = F.col("sales_qty"), F.col("pocket_price"), F.col("standard_cost")
    clean = silver.filter((qty > 0) & (F.col("blue_jobber_price") > 0))
    base = clean.select(*FACT_DIMENSIONS, *FACT_BASE)
    with_ratios = ratio_columns(base, guard="null", scale=2, names=FACT_RATIOS)
    return with_ratios.select(
        *FACT_DIMENSIONS,
        *FACT_BASE,
        (pocket - std).alias("contribution_margin"),
        *FACT_RATIOS,
        (std - F.col("material_cost")).alias("conversion_cost"),
        (pocket * qty).alias("pocket_revenue"),
        ((pocket - std) * qty).alias("margin_dollars"),
    )


def waterfall_fact_view(transactions: DataFrame) -> DataFrame:
    """Ad-hoc SQL view variant: all input columns plus six unrounded measures.

    Positive guard (a zero *or negative* denominator gives 0.0); quantity > 0 only.
    """
    kept = transactions.filter(F.col("sales_qty") > 0)
    kept = kept.withColumn("contribution_margin", F.col("pocket_price") - F.col("standard_cost"))
    return ratio_columns(kept, guard="positive", scale=None, names=FACT_RATIOS)


def fact_slice(fact: DataFrame, filters: TxnFilter | None = None, limit: int | None = None) -> DataFrame:
    """The 21-column fact projection under equality filters; ``limit`` is opt-in."""
    out = apply_filters(fact, filters).select(*FACT_SLICE_COLUMNS)
    return out.limit(limit) if limit is not None else out


def _r2(c: Column) -> Column:
    return round_half_up(c, 2)


def customer_profitability(fact: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Customer aggregate with volume-weighted percentages and a margin tier.

    The weighted percentages are ratios of exact sums (e.g. sum of margin
    dollars over sum of pocket revenue), NULL when the denominator is 0.
    ``keys`` defaults to (sold_to, corporate_group, country, pso, year).
    """
    keys = keys or CUSTOMER_KEYS
    agg = fact.groupBy(*keys).agg(
        exact_sum("sales_qty").alias("_qty"),
        exact_sum("pocket_revenue").alias("_rev"),
        exact_sum("margin_dollars").alias("_md"),
        exact_sum("blue_jobber_price * sales_qty").alias("_blue"),
        exact_sum("deductions * sales_qty").alias("_ded"),
        exact_sum("bonuses * sales_qty").alias("_bon"),
        exact_sum("invoice_price * sales_qty").alias("_inv"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    out = agg.select(
        *keys,
        F.col("_qty").cast("double").alias("total_qty"),
        F.col("_rev").cast("double").alias("total_pocket_revenue"),
        F.col("_md").cast("double").alias("total_margin_dollars"),
        _r2(exact_ratio(F.col("_md"), F.col("_rev"))).alias("wavg_margin_pct"),
        _r2(exact_ratio(F.col("_rev"), F.col("_blue"))).alias("wavg_realization_pct"),
        _r2(exact_ratio(F.col("_ded"), F.col("_blue"))).alias("wavg_deduction_pct"),
        _r2(exact_ratio(F.col("_bon"), F.col("_inv"))).alias("wavg_bonus_pct"),
        "transaction_count",
    )
    return out.withColumn("margin_tier", margin_tier(F.col("wavg_margin_pct")))


def _exact_avg_2dp(name: str) -> Column:
    """Average of a 2-dp column: exact decimal sum over the non-null count."""
    n = F.count(F.col(name))
    return F.when(n > 0, exact_sum(name).cast("double") / n)


def segment_averages(fact: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Unweighted averages of the rounded row percentages per segment (2 dp)."""
    keys = keys or SEGMENT_KEYS
    return fact.groupBy(*keys).agg(
        _r2(_exact_avg_2dp("deduction_pct")).alias("avg_deduction_pct"),
        _r2(_exact_avg_2dp("bonus_pct")).alias("avg_bonus_pct"),
        _r2(_exact_avg_2dp("margin_pct")).alias("avg_margin_pct"),
        _r2(_exact_avg_2dp("realization_pct")).alias("avg_realization_pct"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def waterfall_alerts(fact: DataFrame, detected_at: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """Segments breaching a threshold, with alert type and severity.

    Rules apply in order margin < 10, margin < 20, deduction > 18, bonus > 8,
    realization < 70; the first match wins; segments with no match are dropped.
    ``detected_at`` defaults to ``current_timestamp()``.
    """
    seg = segment_averages(fact, keys)
    m, d, b, r = (F.col(c) for c in ("avg_margin_pct", "avg_deduction_pct", "avg_bonus_pct", "avg_realization_pct"))
    out = seg.select(
        *seg.columns,
        alert_type(m, d, b, r).alias("alert_type"),
        alert_severity(m, d, b, r).alias("severity"),
        (F.current_timestamp() if detected_at is None else detected_at).alias("detected_at"),
    )
    return out.filter(F.col("alert_type").isNotNull())


def active_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts ordered HIGH, MEDIUM, other; newest first; then by segment."""
    cols = [
        "country",
        "pso",
        "year",
        "alert_type",
        "severity",
        "avg_margin_pct",
        "avg_deduction_pct",
        "avg_bonus_pct",
        "detected_at",
    ]
    return alerts.select(*cols).orderBy(
        severity_rank(F.col("severity")), F.col("detected_at").desc(), "country", "pso", "year"
    )


def customers_by_margin(customers: DataFrame) -> DataFrame:
    """Customer rows by weighted margin ascending (NULLs last, as the warehouse sorts)."""
    cols = [
        "sold_to",
        "corporate_group",
        "country",
        "pso",
        "year",
        "total_qty",
        "total_pocket_revenue",
        "total_margin_dollars",
        "wavg_margin_pct",
        "wavg_realization_pct",
        "margin_tier",
    ]
    return customers.select(*cols).orderBy(F.col("wavg_margin_pct").asc_nulls_last(), "sold_to", "country", "year")
