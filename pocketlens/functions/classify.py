"""Chained CASE classifications: quality flag, margin tier, alerts, display bands.

Each returns a Column built from ``when`` chains so it folds into the
surrounding projection; the first matching branch wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def quality_flag(
    blue: Column | None = None,
    deductions: Column | None = None,
    invoice: Column | None = None,
    bonuses: Column | None = None,
    pocket: Column | None = None,
    standard_cost: Column | None = None,
    material_cost: Column | None = None,
) -> Column:
    """Data-quality flag of a transaction (flags, never drops).

    ``material_cost`` is the source column: a NULL cost compares as NULL and falls
    through to the next rule.
    """
    blue = F.col("blue_jobber_price") if blue is None else blue
    deductions = F.col("deductions") if deductions is None else deductions
    invoice = F.col("invoice_price") if invoice is None else invoice
    bonuses = F.col("bonuses") if bonuses is None else bonuses
    pocket = F.col("pocket_price") if pocket is None else pocket
    standard_cost = F.col("standard_cost") if standard_cost is None else standard_cost
    material_cost = F.col("material_cost") if material_cost is None else material_cost
    tol = F.lit(S.ARITHMETIC_TOLERANCE)
    invoice_mismatch, pocket_mismatch, cost_exceeds, bad_cost, negative_pocket = S.QUALITY_FLAGS
    return (
        F.when(F.abs(invoice - (blue - deductions)) > tol, F.lit(invoice_mismatch))
        .when(F.abs(pocket - (invoice - bonuses)) > tol, F.lit(pocket_mismatch))
        .when(material_cost > standard_cost, F.lit(cost_exceeds))
        .when(standard_cost <= 0, F.lit(bad_cost))
        .when(pocket < 0, F.lit(negative_pocket))
        .otherwise(F.lit(S.QUALITY_VALID))
    )


def margin_tier(margin_pct: Column) -> Column:
    """Tier of a (rounded) weighted margin %; NULL margin falls to the last tier."""
    expr = None
    for label, floor in S.MARGIN_TIERS:
        cond = margin_pct > F.lit(floor)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(S.MARGIN_TIER_FLOOR))


def _alert_conditions(margin: Column, deduction: Column, bonus: Column, realization: Column) -> list[Column]:
    return [
        margin < F.lit(S.ALERT_CRITICAL_MARGIN),
        margin < F.lit(S.ALERT_LOW_MARGIN),
        deduction > F.lit(S.ALERT_HIGH_DEDUCTIONS),
        bonus > F.lit(S.ALERT_HIGH_BONUSES),
        realization < F.lit(S.ALERT_LOW_REALIZATION),
    ]


def alert_type(margin: Column, deduction: Column, bonus: Column, realization: Column) -> Column:
    """First breached rule of a segment, else NULL."""
    expr = None
    for cond, (name, _) in zip(_alert_conditions(margin, deduction, bonus, realization), S.ALERT_RULES):
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def alert_severity(margin: Column, deduction: Column, bonus: Column, realization: Column) -> Column:
    """Severity of the first breached rule, else NULL."""
    expr = None
    for cond, (_, sev) in zip(_alert_conditions(margin, deduction, bonus, realization), S.ALERT_RULES):
        expr = F.when(cond, F.lit(sev)) if expr is None else expr.when(cond, F.lit(sev))
    return expr


def severity_rank(severity: Column) -> Column:
    """Sort key: HIGH, MEDIUM, then anything else."""
    high, medium = S.SEVERITY_ORDER
    return F.when(severity == high, F.lit(1)).when(severity == medium, F.lit(2)).otherwise(F.lit(3))


def margin_health(margin_pct: Column) -> Column:
    """Display band of a margin %: green / amber / red (lower bounds inclusive)."""
    (g, g_floor), (a, a_floor) = S.HEALTH_BANDS
    return F.when(margin_pct >= g_floor, F.lit(g)).when(margin_pct >= a_floor, F.lit(a)).otherwise(F.lit(S.HEALTH_FLOOR))


def z_band(z: Column) -> Column:
    """Display band of a z-score by magnitude (lower bounds inclusive)."""
    (hi, hi_floor), (mid, mid_floor) = S.Z_BANDS
    az = F.abs(z)
    return F.when(az >= hi_floor, F.lit(hi)).when(az >= mid_floor, F.lit(mid)).otherwise(F.lit(S.Z_BAND_FLOOR))
