"""Silver layer: validity filter, latest-record dedup, data-quality flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import quality_flag
from ..schema import NATURAL_KEY

# Dedup order: newest load first, then every measure and the remaining
# attributes descending, so the surviving row is fully determined.
DEDUP_ORDER = [
    "_loaded_at",
    "sales_qty",
    "blue_jobber_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "standard_cost",
    "material_cost",
    "corporate_group",
    "pso",
]

SILVER_COLUMNS = [
    "country",
    "year",
    "material",
    "sales_designation",
    "sold_to",
    "corporate_group",
    "sales_qty",
    "blue_jobber_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "pso",
    "standard_cost",
    "material_cost",
    "data_quality_flag",
]


def valid_base(df: DataFrame) -> DataFrame:
    """Rows with a positive, non-null quantity and blue price."""
    qty, blue = F.col("sales_qty"), F.col("blue_jobber_price")
    return df.filter(qty.isNotNull() & (qty > 0) & blue.isNotNull() & (blue > 0))


def dedup_latest(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Keep one row per key: the greatest by ``order`` (descending, NULLs last).

    Same result as ``row_number() OVER (PARTITION BY keys ORDER BY order DESC) = 1``
    with a total order, but planned as an aggregation: ``max(struct(order..., rest...))``
    is combined map-side, so a key holding a third of all rows sends one row per
    map task through the shuffle instead of all of its rows to one sorter.
    Struct comparison puts NULL below any value, which is DESC NULLS LAST.
    """
    keys = keys or NATURAL_KEY
    order = [c for c in (order or DEDUP_ORDER) if c in df.columns and c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[F.col(c) for c in order + rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def silver_transactions(bronze: DataFrame) -> DataFrame:
    """Validity filter -> dedup -> NULL material cost to 0 -> quality flag.

    The flag reads the *source* ``material_cost`` (NULL falls through), since a
    projection cannot see its own aliases.
    """
    deduped = dedup_latest(valid_base(bronze))
    return deduped.select(
        *[c for c in SILVER_COLUMNS[:14]],
        F.coalesce(F.col("material_cost"), F.lit(0.0)).alias("material_cost"),
        quality_flag().alias("data_quality_flag"),
    )
