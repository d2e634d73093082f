"""Dimension filters and plan-time column checks."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TxnFilter:
    """Equality filters over the six filterable dimensions; ``None`` = no filter."""

    country: str | None = None
    year: int | None = None
    material: str | None = None
    pso: str | None = None
    corporate_group: str | None = None
    sold_to: str | None = None

    def items(self) -> list[tuple[str, object]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None]

    def is_empty(self) -> bool:
        return not self.items()


def filter_predicate(df: DataFrame, filters: TxnFilter | None) -> Column | None:
    """AND of ``col == value`` for the set filters on columns present in ``df``.

    A filter on a column the frame lacks is skipped, as in the reference.
    """
    if filters is None:
        return None
    preds = [F.col(name) == F.lit(value) for name, value in filters.items() if name in df.columns]
    if not preds:
        return None
    return reduce(lambda a, b: a & b, preds)


def apply_filters(df: DataFrame, filters: TxnFilter | None) -> DataFrame:
    """Filter ``df``; the predicate is a plain Column so Catalyst pushes it to the scan."""
    pred = filter_predicate(df, filters)
    return df if pred is None else df.filter(pred)


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Raise ``ValueError`` naming missing columns.  Plan-time only, no job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
