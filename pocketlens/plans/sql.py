"""Ad-hoc read-only SQL over the registered views.

A query must begin with SELECT, WITH or EXPLAIN, and is wrapped as a subquery,
``SELECT * FROM (<q>)``, which only parses when ``q`` is a query: a ``WITH ...
INSERT``, a DDL statement or ``a; b`` is a ParseException.  What it reads and calls is
judged on its parsed and analysed trees (:mod:`~pocketlens.plans.guard`).  EXPLAIN is
answered with Spark's own ``EXPLAIN`` of the wrapped query.

:func:`~pocketlens.session.reader_session` gives the queries a session of their own, in which nothing but the views
is registered: names of the caller's temporary views neither clash nor can be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.gold import customer_profitability, waterfall_alerts, waterfall_fact, waterfall_fact_view
from ..operators.silver import silver_transactions
from ..schema import READONLY_FIRST_WORDS
from ..session import reader_session  # noqa: F401 - part of this module's interface
from .guard import ReadOnlyViolation, TreeGuard

VIEW_NAMES = ("transactions", "waterfall_fact", "customer_profitability", "waterfall_alerts")
EXPLAIN_MODES = ("EXTENDED", "FORMATTED", "CODEGEN", "COST")


def register_views(spark: SparkSession, transactions: DataFrame, silver: DataFrame | None = None) -> dict[str, DataFrame]:
    """Register the four views the questions are asked against, in the session of the frames.

    ``transactions`` is the raw (bronze) frame; ``waterfall_fact`` is the
    unrounded view over it (positive guard).  ``customer_profitability`` and
    ``waterfall_alerts`` are the gold tables built over the deduplicated silver
    layer (derived from ``transactions`` when ``silver`` is not given).
    """
    silver = silver if silver is not None else silver_transactions(transactions)
    fact = waterfall_fact(silver)
    views = {
        "transactions": transactions,
        "waterfall_fact": waterfall_fact_view(transactions),
        "customer_profitability": customer_profitability(fact),
        "waterfall_alerts": waterfall_alerts(fact),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def _first_word(query: str) -> str:
    q = query.strip()
    return q.split()[0].upper() if q else ""


def run_readonly_sql(spark: SparkSession, query: str, limit: int | None = None) -> DataFrame:
    """Run one read-only query; all rows, or at most ``limit`` if it is given.

    Raises :class:`ReadOnlyViolation` for anything but SELECT / WITH / EXPLAIN over the
    registered views, and Spark's ParseException for text that is not a single query.
    """
    first = _first_word(query)
    if first not in READONLY_FIRST_WORDS:
        raise ReadOnlyViolation(f"a query begins with one of {', '.join(READONLY_FIRST_WORDS)}")
    body = query.strip().rstrip(";").strip()
    explain = first == "EXPLAIN"
    mode = ""
    if explain:
        body = body.split(None, 1)[1] if len(body.split(None, 1)) > 1 else ""
        word = _first_word(body)
        if word in EXPLAIN_MODES:
            mode, body = f" {word}", body.split(None, 1)[1] if len(body.split(None, 1)) > 1 else ""
    wrapped = f"SELECT * FROM (\n{body}\n)"
    if limit is not None:
        wrapped += f" LIMIT {int(limit)}"
    checked = TreeGuard(spark, VIEW_NAMES).check(wrapped)
    return spark.sql(f"EXPLAIN{mode} {wrapped}") if explain else checked
