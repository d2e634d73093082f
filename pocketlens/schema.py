"""Transaction schema, column groups and the fixed domain values of the waterfall.

The bronze layer stores the 15 business fields plus the ``_loaded_at`` load
timestamp.  Prices are DECIMAL(18,4) at rest in the source system; the analytic
layer works on doubles and uses exact decimal sums where totals are reported
(see :mod:`pocketlens.functions.rounding`).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Natural key of a transaction (dedup key of the silver layer).
NATURAL_KEY = ["material", "sold_to", "year", "country", "sales_designation"]

PRICE_COLUMNS = [
    "blue_jobber_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "standard_cost",
    "material_cost",
]

MEASURE_COLUMNS = ["sales_qty", *PRICE_COLUMNS]

DIMENSION_COLUMNS = [
    "country",
    "year",
    "material",
    "sales_designation",
    "sold_to",
    "corporate_group",
    "pso",
]

# Column order of the bronze table (source DDL order).
BRONZE_COLUMNS = [
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
    "_loaded_at",
]

# Analytic (double) schema of the bronze table.  Nullability follows the DDL.
TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("country", T.StringType(), False),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("material", T.StringType(), False),
        T.StructField("sales_designation", T.StringType(), False),
        T.StructField("sold_to", T.StringType(), False),
        T.StructField("corporate_group", T.StringType(), True),
        T.StructField("sales_qty", T.DoubleType(), False),
        T.StructField("blue_jobber_price", T.DoubleType(), False),
        T.StructField("deductions", T.DoubleType(), False),
        T.StructField("invoice_price", T.DoubleType(), False),
        T.StructField("bonuses", T.DoubleType(), False),
        T.StructField("pocket_price", T.DoubleType(), False),
        T.StructField("pso", T.StringType(), False),
        T.StructField("standard_cost", T.DoubleType(), True),
        T.StructField("material_cost", T.DoubleType(), True),
        T.StructField("_loaded_at", T.TimestampNTZType(), False),
    ]
)

# Storage schema: the decimal types of the source DDL.
STORAGE_DECIMAL = T.DecimalType(18, 4)

# Required columns of the analytic functions.
WATERFALL_REQUIRED = [
    "sales_qty",
    "blue_jobber_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "standard_cost",
    "material_cost",
]
PERIOD_REQUIRED = [
    "year",
    "sales_qty",
    "blue_jobber_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "standard_cost",
]
OUTLIER_REQUIRED = [
    "sold_to",
    "corporate_group",
    "country",
    "pso",
    "material",
    "year",
    "sales_qty",
    "blue_jobber_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "standard_cost",
]

# Dimensions accepted by the equality filter (the order the filter applies them).
FILTER_DIMENSIONS = ["country", "year", "material", "pso", "corporate_group", "sold_to"]

# ---------------------------------------------------------------------------
# These labels and thresholds must equal the reference's for
# identical results.  They are stated once, here, in their natural order.
# ---------------------------------------------------------------------------

# Data-quality flags (first match wins, in this order), then the pass label.
QUALITY_FLAGS = [
    "INVOICE_MISMATCH",
    "POCKET_MISMATCH",
    "MATERIAL_COST_EXCEEDS_STANDARD",
    "ZERO_OR_NEGATIVE_COST",
    "NEGATIVE_POCKET_PRICE",
]
QUALITY_VALID = "VALID"
ARITHMETIC_TOLERANCE = 0.01

# Margin tiers: (label, exclusive lower bound on the rounded margin %).
MARGIN_TIERS = [
    ("Tier 1 - Premium", 35.0),
    ("Tier 2 - Healthy", 25.0),
    ("Tier 3 - Acceptable", 15.0),
    ("Tier 4 - Low", 5.0),
]
MARGIN_TIER_FLOOR = "Tier 5 - Destructive"

# Alert rules in evaluation order: (alert_type, severity).
ALERT_RULES = [
    ("CRITICAL_MARGIN", "HIGH"),  # avg margin % < 10
    ("LOW_MARGIN", "MEDIUM"),  # avg margin % < 20
    ("HIGH_DEDUCTIONS", "HIGH"),  # avg deduction % > 18
    ("HIGH_BONUSES", "MEDIUM"),  # avg bonus % > 8
    ("LOW_REALIZATION", "MEDIUM"),  # avg realization % < 70
]
ALERT_CRITICAL_MARGIN = 10.0
ALERT_LOW_MARGIN = 20.0
ALERT_HIGH_DEDUCTIONS = 18.0
ALERT_HIGH_BONUSES = 8.0
ALERT_LOW_REALIZATION = 70.0
SEVERITY_ORDER = ["HIGH", "MEDIUM"]

# Outlier scoring.
MIN_PEER_SIZE = 3
HIGH_Z = 2.5
MED_Z = 1.8
OUTLIER_METRICS = [
    ("margin_pct", "low_is_bad"),
    ("deduction_pct", "high_is_bad"),
    ("bonus_pct", "high_is_bad"),
    ("realization_pct", "low_is_bad"),
]
VOLUME_BAND_QUANTILES = (0.33, 0.67)
VOLUME_BANDS = ["LOW", "MEDIUM", "HIGH"]
# Standard deviations at or below this are treated as zero (float noise).
STD_EPSILON = 1e-9

# Report bands.
HEALTH_BANDS = [("green", 25.0), ("amber", 15.0)]
HEALTH_FLOOR = "red"
Z_BANDS = [("red", 3.0), ("orange", 2.0)]
Z_BAND_FLOOR = "gray"

# Waterfall chart steps, in display order.
WATERFALL_STEPS = ["Blue Price", "Deductions", "Invoice", "Bonuses", "Pocket", "Std Cost", "Margin"]
# Margin bridge steps, in display order.
BRIDGE_STEPS = ["Price", "Deduct", "Bonus", "Cost", "Volume", "Mix"]

# Schema tests of the gold layer.
ACCEPTED_YEARS = [2023, 2024, 2025, 2026]
TIER_LABELS = [label for label, _ in MARGIN_TIERS] + [MARGIN_TIER_FLOOR]

# Read-only SQL.
READONLY_FIRST_WORDS = ("SELECT", "WITH", "EXPLAIN")
