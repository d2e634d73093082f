"""Period metrics and the year-over-year margin bridge.

The bridge splits the change in margin dollars between two years into price,
deduction, bonus and cost effects (each the change of a weighted average times
the base volume), a volume effect (volume change times base margin per unit),
and a residual mix effect, so the six effects sum to the total change.

Both periods come out of one aggregation (``groupBy("year")`` over the two
years) and are pivoted into one row by a second aggregation over two rows; there
is no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import TxnFilter, apply_filters, require_columns
from ..functions.ratios import guarded_ratio
from ..functions.rounding import exact_sum, round_half_up, total_to_double
from ..schema import PERIOD_REQUIRED
from .waterfall import wavg

PERIOD_WAVGS = [
    ("wavg_blue_price", "blue_jobber_price"),
    ("wavg_deductions", "deductions"),
    ("wavg_invoice_price", "invoice_price"),
    ("wavg_bonuses", "bonuses"),
    ("wavg_pocket_price", "pocket_price"),
    ("wavg_standard_cost", "standard_cost"),
]
PERIOD_FIELDS = [
    "year",
    *[name for name, _ in PERIOD_WAVGS],
    "wavg_margin_pct",
    "total_qty",
    "total_pocket_revenue",
    "total_margin_dollars",
    "transaction_count",
]
EFFECTS = [
    "price_effect",
    "deduction_effect",
    "bonus_effect",
    "cost_effect",
    "volume_effect",
    "mix_effect",
    "total_margin_change",
]


def _r4(c: Column) -> Column:
    return round_half_up(c, 4)


def _r2(c: Column) -> Column:
    return round_half_up(c, 2)


def period_metrics(df: DataFrame, year: int | None = None) -> DataFrame:
    """Weighted averages (4 dp), margin % (2 dp) and totals per year.

    ``year`` restricts to one period; without it every year is computed in the
    same single aggregation.  A year with no positive-quantity rows has no row.
    """
    require_columns(df, PERIOD_REQUIRED)
    rows = df.filter(F.col("sales_qty") > 0)
    if year is not None:
        rows = rows.filter(F.col("year") == F.lit(year))
    agg = rows.groupBy("year").agg(
        *[wavg(src).alias(f"_{name}") for name, src in PERIOD_WAVGS],
        exact_sum("sales_qty").alias("_qty"),
        exact_sum("pocket_price * sales_qty").alias("_rev"),
        exact_sum("(pocket_price - standard_cost) * sales_qty").alias("_md"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    unit_margin = F.col("_wavg_pocket_price") - F.col("_wavg_standard_cost")
    return agg.select(
        F.col("year"),
        *[_r4(F.col(f"_{name}")).alias(name) for name, _ in PERIOD_WAVGS],
        _r2(guarded_ratio(unit_margin, F.col("_wavg_pocket_price"), "nonzero")).alias("wavg_margin_pct"),
        total_to_double(F.col("_qty"), 4).alias("total_qty"),
        total_to_double(F.col("_rev"), 2).alias("total_pocket_revenue"),
        total_to_double(F.col("_md"), 2).alias("total_margin_dollars"),
        F.col("transaction_count"),
    )


def margin_bridge(
    df: DataFrame,
    base_year: int,
    current_year: int,
    filters: TxnFilter | None = None,
    nested: bool = True,
) -> DataFrame:
    """One-row bridge from ``base_year`` to ``current_year`` (no row if either is empty).

    Effects use the already-rounded period values (weighted averages at 4 dp,
    margin dollars at 2 dp) and are rounded to 2 dp.  ``filters`` is an
    extension: the reference always bridges the whole frame.  With
    ``nested=True`` the periods are ``base`` / ``current`` structs; otherwise
    they are flattened to ``base_*`` / ``current_*`` columns.
    """
    scoped = apply_filters(df, filters).filter(F.col("year").isin(base_year, current_year))
    periods = period_metrics(scoped)
    fields = [F.col(c) for c in PERIOD_FIELDS]
    pair = periods.agg(
        F.max(F.when(F.col("year") == base_year, F.struct(*fields))).alias("base"),
        F.max(F.when(F.col("year") == current_year, F.struct(*fields))).alias("current"),
    ).filter(F.col("base").isNotNull() & F.col("current").isNotNull())

    b = lambda name: F.col(f"base.{name}")
    c = lambda name: F.col(f"current.{name}")
    base_qty = b("total_qty")
    price = (c("wavg_blue_price") - b("wavg_blue_price")) * base_qty
    deduction = -(c("wavg_deductions") - b("wavg_deductions")) * base_qty
    bonus = -(c("wavg_bonuses") - b("wavg_bonuses")) * base_qty
    cost = -(c("wavg_standard_cost") - b("wavg_standard_cost")) * base_qty
    volume = (c("total_qty") - base_qty) * (b("wavg_pocket_price") - b("wavg_standard_cost"))
    total = c("total_margin_dollars") - b("total_margin_dollars")
    mix = total - (price + deduction + bonus + cost + volume)

    out = pair.select(
        F.lit(base_year).cast("int").alias("base_year"),
        F.lit(current_year).cast("int").alias("current_year"),
        "base",
        "current",
        _r2(price).alias("price_effect"),
        _r2(deduction).alias("deduction_effect"),
        _r2(bonus).alias("bonus_effect"),
        _r2(cost).alias("cost_effect"),
        _r2(volume).alias("volume_effect"),
        _r2(mix).alias("mix_effect"),
        _r2(total).alias("total_margin_change"),
    )
    return out if nested else flatten_bridge(out)


def flatten_bridge(bridge: DataFrame) -> DataFrame:
    """``base``/``current`` structs to ``base_<field>``/``current_<field>`` columns."""
    period_cols = [
        F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in ("base", "current") for name in PERIOD_FIELDS[1:]
    ]
    return bridge.select("base_year", "current_year", *period_cols, *EFFECTS)
