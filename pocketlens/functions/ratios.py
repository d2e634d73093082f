"""Per-row waterfall ratios under the three zero-guard rules of the reference.

=========  =====================================  ===========================
guard      denominator rule                       used by
=========  =====================================  ===========================
"null"     ``d = 0`` -> NULL (``nullif``)          gold fact table (rounded)
"positive" ``d > 0`` else 0.0 (negative d too)     ad-hoc SQL view (unrounded)
"nonzero"  ``d = 0`` -> 0.0, NULL stays NULL      outlier scoring (unrounded)
=========  =====================================  ===========================

Every ratio is ``numerator / denominator * 100`` in that operation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounding import round_half_up

# name -> (numerator, denominator) as column expressions over the base measures.
RATIO_DEFINITIONS = {
    "margin_pct": (lambda: F.col("pocket_price") - F.col("standard_cost"), lambda: F.col("pocket_price")),
    "deduction_pct": (lambda: F.col("deductions"), lambda: F.col("blue_jobber_price")),
    "bonus_pct": (lambda: F.col("bonuses"), lambda: F.col("invoice_price")),
    "realization_pct": (lambda: F.col("pocket_price"), lambda: F.col("blue_jobber_price")),
    "leakage_pct": (
        lambda: F.col("blue_jobber_price") - F.col("pocket_price"),
        lambda: F.col("blue_jobber_price"),
    ),
}

ALL_RATIOS = list(RATIO_DEFINITIONS)
OUTLIER_RATIOS = ["margin_pct", "deduction_pct", "bonus_pct", "realization_pct"]


def guarded_ratio(num: Column, den: Column, guard: str) -> Column:
    """``num / den * 100`` with the chosen zero-denominator rule."""
    hundred = F.lit(100.0)
    if guard == "null":
        return num / F.nullif(den, F.lit(0)) * hundred
    if guard == "positive":
        return F.when(den > 0, num / den * hundred).otherwise(F.lit(0.0))
    if guard == "nonzero":
        return F.when(den == 0, F.lit(0.0)).otherwise(num / den * hundred)
    raise ValueError(f"unknown guard {guard!r}; expected 'null', 'positive' or 'nonzero'")


def ratio_column(name: str, guard: str, scale: int | None = None) -> Column:
    num, den = RATIO_DEFINITIONS[name]
    c = guarded_ratio(num(), den(), guard)
    if scale is not None:
        c = round_half_up(c, scale)
    return c.alias(name)


def ratio_columns(
    df: DataFrame,
    guard: str = "null",
    scale: int | None = 2,
    names: list[str] | None = None,
    only_missing: bool = False,
) -> DataFrame:
    """Add ratio columns to ``df`` in one projection.

    ``only_missing`` adds a ratio only when ``df`` lacks a column of that name
    (the outlier path keeps caller-supplied ratios).
    """
    names = names or ALL_RATIOS
    if only_missing:
        names = [n for n in names if n not in df.columns]
    if not names:
        return df
    return df.withColumns({n: ratio_column(n, guard, scale) for n in names})


def metric_columns(df: DataFrame) -> DataFrame:
    """The four outlier metrics, unrounded, nonzero guard, added only if absent."""
    return ratio_columns(df, guard="nonzero", scale=None, names=OUTLIER_RATIOS, only_missing=True)
