"""Rounding and exact-total helpers.

Two rules keep results identical across engines, runs and partitionings:

* Row-level rounding is ``floor(x * 10^dp + 0.5) / 10^dp`` on doubles
  (:func:`round_half_up`).  It is plain IEEE arithmetic, so every engine that
  evaluates the same expression in the same order gets the same bits, unlike
  ``round(double, dp)`` whose tie handling differs between engines.
* Totals are sums of ``CAST(x AS DECIMAL(28, 8))`` (:func:`exact_sum`).  Prices
  carry 4 decimals and quantities at most 4, so the products are exact at scale
  8 and the sums are independent of row order; a double sum is not, and its last
  bits would flip the 2-dp ties that are common in money totals.

Both forms stay inside whole-stage codegen (no UDFs).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_TYPE = "decimal(28,8)"


def round_half_up(c: Column, dp: int) -> Column:
    """Round a double column to ``dp`` decimals, ties upward (floor form).

    Valid while ``|c| * 10^dp`` fits a long (|c| < 9e14 at 4 dp), which holds for
    unit prices and percentages; totals are rounded by :func:`total_to_double`.
    """
    scale = float(10**dp)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def exact(c: Column) -> Column:
    """Cast a double expression to the exact accumulation type."""
    return c.cast(EXACT_TYPE)


def exact_sum(c: Column | str) -> Column:
    """Order-independent sum of a double expression at 8 decimals (NULLs skipped).

    Equal to ``sum(CAST(c AS DECIMAL(28,8)))`` but computed with three
    fixed-width ``bigint`` sums, which stay in the hash aggregate's mutable
    buffer (a DECIMAL(38) buffer goes through ``BigDecimal`` on every row and
    is about five times slower).  Each value ``w`` is split into its floor
    ``a`` and the fraction in units of 1e-8, ``r = round((w - a) * 1e8)``,
    and ``r`` into two 4-digit limbs; the limb sums cannot overflow below
    ~9e14 rows.  The limbs are recombined once per group into DECIMAL(38,8).
    Exact for values carrying at most 8 decimals with ``|w| < 2e7``; beyond
    that the double itself holds fewer decimals and the last digit follows
    the double.

    ``c`` may be SQL expression text (preferred: one JVM call builds the whole
    expression) or a Column.
    """
    if isinstance(c, str):
        return F.expr(exact_sum_sql(c))
    whole = F.floor(c)
    units = F.floor((c - whole) * F.lit(1e8) + F.lit(0.5))
    hi = F.floor(units / F.lit(1e4))
    lo = units - hi * F.lit(10000)
    return _recombine(F.sum(whole), F.sum(hi), F.sum(lo))


def exact_sum_sql(x: str) -> str:
    """SQL text of :func:`exact_sum` over the SQL expression ``x``."""
    w = f"({x})"
    units = f"floor(({w} - floor({w})) * 1e8D + 0.5D)"
    hi = f"floor({units} / 1e4D)"
    lo = f"({units} - {hi} * 10000)"
    frac_units = f"CAST(CAST(sum({hi}) AS DECIMAL(29,0)) * 10000 + CAST(sum({lo}) AS DECIMAL(29,0)) AS DECIMAL(29,0))"
    frac = f"CAST({frac_units} * CAST(0.00000001 AS DECIMAL(8,8)) AS DECIMAL(37,8))"
    return f"(CAST(sum(floor({w})) AS DECIMAL(37,8)) + {frac})"


def _recombine(whole: Column, hi: Column, lo: Column) -> Column:
    """``whole + (hi * 1e4 + lo) * 1e-8`` as DECIMAL(38,8), with no precision loss."""
    frac_units = (hi.cast("decimal(29,0)") * F.lit(10000) + lo.cast("decimal(29,0)")).cast("decimal(29,0)")
    frac = (frac_units * F.lit(Decimal("0.00000001")).cast("decimal(8,8)")).cast("decimal(37,8)")
    return whole.cast("decimal(37,8)") + frac


def decimal_sum(c: Column) -> Column:
    """The plain ``sum(CAST(c AS DECIMAL(28,8)))`` (reference form of :func:`exact_sum`)."""
    return F.sum(exact(c))


def total_to_double(total: Column, dp: int | None = None) -> Column:
    """Exact decimal total to double, optionally rounded to ``dp`` decimals first.

    Decimal rounding is HALF_UP (away from zero at ties) on the exact value.
    """
    if dp is not None:
        total = F.round(total, dp)
    return total.cast("double")


def exact_ratio(numerator: Column, denominator: Column, guard: str = "null") -> Column:
    """``numerator / denominator * 100`` from two exact totals, as a double.

    ``guard`` selects the zero-denominator rule: ``"null"`` gives NULL,
    ``"nonzero"`` gives 0.0 when the denominator is 0.
    """
    num = numerator.cast("double")
    den = denominator.cast("double")
    if guard == "null":
        return num / F.nullif(den, F.lit(0.0)) * F.lit(100.0)
    if guard == "nonzero":
        return F.when(den != 0, num / den * F.lit(100.0)).otherwise(F.lit(0.0))
    raise ValueError(f"unknown guard {guard!r}")
