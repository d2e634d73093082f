"""Column-level building blocks (all built-in Spark expressions, no UDFs)."""

from .classify import (
    alert_severity,
    alert_type,
    margin_health,
    margin_tier,
    quality_flag,
    severity_rank,
    z_band,
)
from .filters import TxnFilter, apply_filters, filter_predicate, require_columns
from .ratios import guarded_ratio, metric_columns, ratio_columns
from .rounding import exact_ratio, exact_sum, round_half_up, total_to_double

__all__ = [
    "TxnFilter",
    "alert_severity",
    "alert_type",
    "apply_filters",
    "exact_ratio",
    "exact_sum",
    "filter_predicate",
    "guarded_ratio",
    "margin_health",
    "margin_tier",
    "metric_columns",
    "quality_flag",
    "ratio_columns",
    "require_columns",
    "round_half_up",
    "severity_rank",
    "total_to_double",
    "z_band",
]
