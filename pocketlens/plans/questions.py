"""The standing question set, each fixed as a named DataFrame query.

The reference answers these by having a language model improvise SQL; here
each is a plain, parameterised plan over the layers.  Inputs are DataFrames:
``bronze`` (raw transactions), ``silver``, ``fact`` (gold fact), ``customers``
and ``alerts`` (gold aggregates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import margin_health
from ..functions.filters import TxnFilter
from ..functions.rounding import exact_ratio, exact_sum, round_half_up, total_to_double
from ..operators.gold import active_alerts, customer_profitability
from ..operators.outliers import detect_outliers
from ..operators.reports import analyze, bridge_steps
from ..operators.trends import margin_bridge
from ..operators.waterfall import compute_waterfall, waterfall_by
from ..schema import MARGIN_TIER_FLOOR, MARGIN_TIERS


def q_overall_waterfall(bronze: DataFrame) -> DataFrame:
    """Q1: the overall waterfall."""
    return compute_waterfall(bronze)


def q_margin_by_country(bronze: DataFrame) -> DataFrame:
    """Q2: volume-weighted margin % per country, with its health band."""
    wf = waterfall_by(bronze, ["country"])
    return wf.select(
        "country",
        "margin_pct",
        margin_health(F.col("margin_pct")).alias("margin_health"),
        "total_qty",
        "total_pocket_revenue",
        "total_margin_dollars",
        "transaction_count",
    )


def q_low_margin_customers(customers: DataFrame, pso: str, threshold: float = 15.0) -> DataFrame:
    """Q3: customers of one PSO whose weighted margin is below ``threshold``."""
    return (
        customers.filter((F.col("pso") == F.lit(pso)) & (F.col("wavg_margin_pct") < F.lit(threshold)))
        .select("sold_to", "corporate_group", "country", "year", "wavg_margin_pct", "total_pocket_revenue", "margin_tier")
        .orderBy("wavg_margin_pct", "sold_to", "country", "year")
    )


def q_margin_change(bronze: DataFrame, base_year: int, current_year: int) -> DataFrame:
    """Q4: year-to-year margin change as bridge steps."""
    return bridge_steps(margin_bridge(bronze, base_year, current_year))


def q_deduction_by_material(bronze: DataFrame, n: int = 1) -> DataFrame:
    """Q5: material(s) with the highest weighted deduction rate."""
    qty = F.col("sales_qty")
    rates = (
        bronze.filter(qty > 0)
        .groupBy("material")
        .agg(
            exact_sum("deductions * sales_qty").alias("_ded"),
            exact_sum("blue_jobber_price * sales_qty").alias("_blue"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
        .select(
            "material",
            round_half_up(exact_ratio(F.col("_ded"), F.col("_blue")), 2).alias("deduction_rate_pct"),
            total_to_double(F.col("_ded"), 2).alias("total_deduction_dollars"),
            "transaction_count",
        )
    )
    return rates.orderBy(F.col("deduction_rate_pct").desc_nulls_last(), "material").limit(n)


def q_top_customers_revenue(fact: DataFrame, n: int = 5) -> DataFrame:
    """Q6: top customers by pocket revenue over all years (one aggregation)."""
    agg = fact.groupBy("sold_to", "corporate_group").agg(
        exact_sum("pocket_revenue").alias("_rev"),
        exact_sum("margin_dollars").alias("_md"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    out = agg.select(
        "sold_to",
        "corporate_group",
        total_to_double(F.col("_rev"), 2).alias("total_pocket_revenue"),
        round_half_up(exact_ratio(F.col("_md"), F.col("_rev")), 2).alias("wavg_margin_pct"),
        "transaction_count",
    )
    return out.orderBy(F.col("total_pocket_revenue").desc(), "sold_to", "corporate_group").limit(n)


def q_active_alerts(alerts: DataFrame) -> DataFrame:
    """Q7: the active alerts, most severe first."""
    return active_alerts(alerts)


def q_realization_by_pso(bronze: DataFrame, year: int) -> DataFrame:
    """Q8: realization % across PSOs for one year."""
    wf = waterfall_by(bronze, ["pso"], TxnFilter(year=year))
    return wf.select("pso", "realization_pct", "leakage_pct", "blue_price", "pocket_price", "transaction_count")


def q_low_tier_groups(fact: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Q9: corporate groups (per country) whose weighted margin puts them in Tier 4 or 5."""
    keys = keys or ["corporate_group", "country"]
    cp = customer_profitability(fact, keys=keys)
    tiers = [MARGIN_TIERS[-1][0], MARGIN_TIER_FLOOR]
    return cp.filter(F.col("margin_tier").isin(*tiers)).select(
        *keys, "wavg_margin_pct", "total_pocket_revenue", "transaction_count", "margin_tier"
    )


def q_full_analysis(bronze: DataFrame, pso: str, base_year: int, current_year: int, reuse: str = "none") -> DataFrame:
    """Q10: full analysis of one PSO, as the insight payload (no row if the PSO has none)."""
    return analyze(bronze, "full_analysis", TxnFilter(pso=pso), base_year, current_year, reuse).payload


def q_bonus_by_material(bronze: DataFrame, n: int = 5) -> DataFrame:
    """Q11: top materials by bonus dollars."""
    qty = F.col("sales_qty")
    agg = (
        bronze.filter(qty > 0)
        .groupBy("material")
        .agg(
            exact_sum("bonuses * sales_qty").alias("_bon"),
            exact_sum("invoice_price * sales_qty").alias("_inv"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
    )
    out = agg.select(
        "material",
        total_to_double(F.col("_bon"), 2).alias("total_bonus_dollars"),
        round_half_up(exact_ratio(F.col("_bon"), F.col("_inv")), 2).alias("wavg_bonus_pct"),
        "transaction_count",
    )
    return out.orderBy(F.col("total_bonus_dollars").desc(), "material").limit(n)


def q_deduction_by_pso(bronze: DataFrame, year: int) -> DataFrame:
    """Q12: deduction rates across PSOs for one year."""
    wf = waterfall_by(bronze, ["pso"], TxnFilter(year=year))
    return wf.select("pso", "deduction_pct", "deductions", "blue_price", "transaction_count")


def q_outlier_customers(silver: DataFrame, reuse: str = "none") -> DataFrame:
    """Q13: customers with flagged high deductions or low margins."""
    flags = detect_outliers(silver, reuse=reuse).filter(F.col("metric").isin("deduction_pct", "margin_pct"))
    return flags.groupBy("sold_to", "corporate_group").agg(
        F.count_if(F.col("metric") == "deduction_pct").alias("deduction_flags"),
        F.count_if(F.col("metric") == "margin_pct").alias("margin_flags"),
        F.count_if(F.col("severity") == "HIGH").alias("high_flags"),
        F.max(F.abs(F.col("z_score"))).alias("max_abs_z"),
    )


__all__ = [
    "q_active_alerts",
    "q_bonus_by_material",
    "q_deduction_by_material",
    "q_deduction_by_pso",
    "q_full_analysis",
    "q_low_margin_customers",
    "q_low_tier_groups",
    "q_margin_by_country",
    "q_margin_change",
    "q_outlier_customers",
    "q_overall_waterfall",
    "q_realization_by_pso",
    "q_top_customers_revenue",
]
