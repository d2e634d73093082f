"""Volume-weighted price waterfall, overall or per dimension set.

One aggregation: partial sums per task, then a final merge (no row shuffle for
the global form; a shuffle of at most one row per group per task when grouped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import TxnFilter, apply_filters, require_columns
from ..functions.ratios import guarded_ratio
from ..functions.rounding import exact_sum, exact_sum_sql, round_half_up, total_to_double
from ..schema import WATERFALL_REQUIRED

# (output name, input column) of the seven weighted averages.
WAVG_OUTPUTS = [
    ("blue_price", "blue_jobber_price"),
    ("deductions", "deductions"),
    ("invoice_price", "invoice_price"),
    ("bonuses", "bonuses"),
    ("pocket_price", "pocket_price"),
    ("standard_cost", "standard_cost"),
    ("material_cost", "material_cost"),
]

WATERFALL_OUTPUTS = [
    "blue_price",
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
    "conversion_cost",
    "total_qty",
    "transaction_count",
    "total_pocket_revenue",
    "total_margin_dollars",
]


def wavg(column: str, weight: str = "sales_qty") -> Column:
    """Aggregate: sum(x * w) / sum(w) over rows where x is not NULL; NULL if sum(w) = 0.

    SQL semantics (NULL measures are skipped, not propagated).  Both sums are
    exact (see :func:`exact_sum`), so the result does not depend on row order.
    ``column`` and ``weight`` are SQL expression text.
    """
    return F.expr(wavg_sql(column, weight))


def wavg_sql(x: str, w: str = "sales_qty") -> str:
    num = exact_sum_sql(f"({x}) * ({w})")
    den = exact_sum_sql(f"CASE WHEN ({x}) IS NOT NULL THEN ({w}) END")
    return f"(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0D))"


def _r4(c: Column) -> Column:
    return round_half_up(c, 4)


def _r2(c: Column) -> Column:
    return round_half_up(c, 2)


def compute_waterfall(
    df: DataFrame,
    filters: TxnFilter | None = None,
    group_by: list[str] | None = None,
) -> DataFrame:
    """Waterfall aggregate: 18 outputs (plus the group columns when grouped).

    Weighted averages round to 4 dp; percentages are computed from the
    (unrounded) weighted averages with a nonzero guard and round to 2 dp;
    ``total_qty`` is truncated to an integer; money totals are exact sums
    rounded to 2 dp.  Rows with quantity <= 0 are excluded.  An empty input
    yields no row (not a row of NULLs).
    """
    require_columns(df, WATERFALL_REQUIRED)
    dims = list(group_by or [])
    rows = apply_filters(df, filters).filter(F.col("sales_qty") > 0)
    aggs = [wavg(src).alias(f"_w_{name}") for name, src in WAVG_OUTPUTS] + [
        exact_sum("sales_qty").alias("_qty"),
        F.count(F.lit(1)).alias("transaction_count"),
        exact_sum("pocket_price * sales_qty").alias("_rev"),
        exact_sum("(pocket_price - standard_cost) * sales_qty").alias("_md"),
    ]
    agg = rows.groupBy(*dims).agg(*aggs) if dims else rows.agg(*aggs)
    agg = agg.filter(F.col("transaction_count") > 0)

    w = {name: F.col(f"_w_{name}") for name, _ in WAVG_OUTPUTS}
    margin = w["pocket_price"] - w["standard_cost"]
    outputs = [_r4(w[name]).alias(name) for name, _ in WAVG_OUTPUTS] + [
        _r4(margin).alias("contribution_margin"),
        _r2(guarded_ratio(margin, w["pocket_price"], "nonzero")).alias("margin_pct"),
        _r2(guarded_ratio(w["deductions"], w["blue_price"], "nonzero")).alias("deduction_pct"),
        _r2(guarded_ratio(w["bonuses"], w["invoice_price"], "nonzero")).alias("bonus_pct"),
        _r2(guarded_ratio(w["pocket_price"], w["blue_price"], "nonzero")).alias("realization_pct"),
        _r2(guarded_ratio(w["blue_price"] - w["pocket_price"], w["blue_price"], "nonzero")).alias("leakage_pct"),
        _r4(w["standard_cost"] - w["material_cost"]).alias("conversion_cost"),
        F.floor(F.col("_qty")).cast("bigint").alias("total_qty"),
        F.col("transaction_count"),
        total_to_double(F.col("_rev"), 2).alias("total_pocket_revenue"),
        total_to_double(F.col("_md"), 2).alias("total_margin_dollars"),
    ]
    return agg.select(*dims, *outputs)


def waterfall_by(df: DataFrame, dims: list[str], filters: TxnFilter | None = None) -> DataFrame:
    """The waterfall for every combination of ``dims`` (one group-by)."""
    return compute_waterfall(df, filters, group_by=dims)
