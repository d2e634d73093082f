"""Report-shaped outputs: chart steps, bridge steps, insight payload, analysis bundle.

All outputs stay DataFrames.  Steps are generated with ``inline`` over an
array of structs (one Generate node, no union); the payload is one JSON string
built with ``to_json`` from three one-row aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.classify import margin_health
from ..functions.filters import TxnFilter, apply_filters, filter_predicate
from ..plans.reuse import shared
from .outliers import detect_outliers, top_outliers
from .trends import margin_bridge
from .waterfall import compute_waterfall

PAYLOAD_WATERFALL_FIELDS = [
    "blue_price",
    "deductions",
    "invoice_price",
    "bonuses",
    "pocket_price",
    "standard_cost",
    "contribution_margin",
    "margin_pct",
    "deduction_pct",
    "bonus_pct",
    "realization_pct",
    "leakage_pct",
    "total_qty",
    "transaction_count",
    "total_pocket_revenue",
    "total_margin_dollars",
]
PAYLOAD_OUTLIER_FIELDS = ["sold_to", "corporate_group", "metric", "value", "peer_mean", "z_score", "severity"]
PAYLOAD_BRIDGE_EFFECTS = [
    "total_margin_change",
    "price_effect",
    "deduction_effect",
    "bonus_effect",
    "cost_effect",
    "volume_effect",
    "mix_effect",
]
ACTIONS = ("waterfall", "outliers", "trends", "narrative", "full_analysis")


def with_margin_health(wf: DataFrame) -> DataFrame:
    """Add the green / amber / red band of ``margin_pct``."""
    return wf.withColumn("margin_health", margin_health(F.col("margin_pct")))


def waterfall_steps(wf: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Seven chart rows per waterfall row: (step, name, base, value, pct).

    ``base`` is where the floating bar starts; ``pct`` is set on the three
    percentage steps.  ``keep`` carries group columns through.
    """
    keep = keep or []
    b, d, inv, bon, p, c, m = (
        F.col(x)
        for x in ("blue_price", "deductions", "invoice_price", "bonuses", "pocket_price", "standard_cost", "contribution_margin")
    )
    zero = F.lit(0.0)
    none = F.lit(None).cast("double")
    rows = [
        (zero, b, none),
        (inv, d, F.col("deduction_pct")),
        (zero, inv, none),
        (p, bon, F.col("bonus_pct")),
        (zero, p, none),
        (m, c, none),
        (zero, m, F.col("margin_pct")),
    ]
    entries = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(name).alias("name"),
                base.cast("double").alias("base"),
                val.cast("double").alias("value"),
                pct.cast("double").alias("pct"),
            )
            for i, (name, (base, val, pct)) in enumerate(zip(S.WATERFALL_STEPS, rows))
        ]
    )
    return wf.select(*keep, F.inline(entries))


def bridge_steps(bridge: DataFrame) -> DataFrame:
    """Six (step, label, value) rows per bridge row, with the two years."""
    effects = ["price_effect", "deduction_effect", "bonus_effect", "cost_effect", "volume_effect", "mix_effect"]
    entries = F.array(
        *[
            F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.col(e).alias("value"))
            for i, (label, e) in enumerate(zip(S.BRIDGE_STEPS, effects))
        ]
    )
    return bridge.select("base_year", "current_year", F.inline(entries))


# JSON scales of the payload numbers: plain fixed-point text in any engine.
PRICE_DECIMAL = "decimal(20,4)"
PCT_DECIMAL = "decimal(20,2)"
MONEY_DECIMAL = "decimal(24,2)"
PAYLOAD_TYPES = {
    "blue_price": PRICE_DECIMAL,
    "deductions": PRICE_DECIMAL,
    "invoice_price": PRICE_DECIMAL,
    "bonuses": PRICE_DECIMAL,
    "pocket_price": PRICE_DECIMAL,
    "standard_cost": PRICE_DECIMAL,
    "contribution_margin": PRICE_DECIMAL,
    "margin_pct": PCT_DECIMAL,
    "deduction_pct": PCT_DECIMAL,
    "bonus_pct": PCT_DECIMAL,
    "realization_pct": PCT_DECIMAL,
    "leakage_pct": PCT_DECIMAL,
    "total_pocket_revenue": MONEY_DECIMAL,
    "total_margin_dollars": MONEY_DECIMAL,
    "value": PRICE_DECIMAL,
    "peer_mean": PRICE_DECIMAL,
    "z_score": PRICE_DECIMAL,
    "base_margin_pct": PCT_DECIMAL,
    "current_margin_pct": PCT_DECIMAL,
    **{e: MONEY_DECIMAL for e in PAYLOAD_BRIDGE_EFFECTS},
}


def _typed(c: str, source=None):
    col = F.col(c) if source is None else source
    t = PAYLOAD_TYPES.get(c)
    return (col.cast(t) if t else col).alias(c)


def _payload_parts(wf: DataFrame, flags: DataFrame | None, bridge: DataFrame | None, top_n: int) -> DataFrame:
    parts = wf.select(F.struct(*[_typed(c) for c in PAYLOAD_WATERFALL_FIELDS]).alias("waterfall"))
    if flags is not None:
        top = top_outliers(flags, top_n)
        keyed = F.struct(
            (-F.abs(F.col("z_score"))).alias("_k"),
            F.col("sold_to").alias("_t1"),
            F.col("metric").alias("_t2"),
            F.col("material").alias("_t3"),
            F.col("country").alias("_t4"),
            F.col("year").alias("_t5"),
            F.col("sales_qty").alias("_t6"),
            F.col("value").alias("_t7"),
            F.struct(*[_typed(c) for c in PAYLOAD_OUTLIER_FIELDS]).alias("o"),
        )
        ordered = F.transform(F.array_sort(F.collect_list(keyed)), lambda e: e["o"])
        outl = top.agg(ordered.alias("_top")).select(F.when(F.size("_top") > 0, F.col("_top")))
        parts = parts.withColumn("top_outliers", outl.scalar())
    else:
        parts = parts.withColumn("top_outliers", F.lit(None))
    if bridge is not None:
        br = bridge.agg(
            F.max(
                F.struct(
                    F.col("base_year"),
                    F.col("current_year"),
                    _typed("base_margin_pct", F.col("base.wavg_margin_pct")),
                    _typed("current_margin_pct", F.col("current.wavg_margin_pct")),
                    *[_typed(e) for e in PAYLOAD_BRIDGE_EFFECTS],
                )
            )
        )
        parts = parts.withColumn("yoy_bridge", br.scalar())
    else:
        parts = parts.withColumn("yoy_bridge", F.lit(None))
    return parts


def insight_payload(
    wf: DataFrame, flags: DataFrame | None = None, bridge: DataFrame | None = None, top_n: int = 5
) -> DataFrame:
    """One row, one ``payload`` JSON string: waterfall (16 fields), the top-N
    outliers by |z| (key omitted when there are none) and the YoY bridge (key
    omitted when absent).  ``wf`` is a one-row waterfall; an empty ``wf`` gives
    no row.  ``bridge`` is a nested :func:`margin_bridge` result.  Numbers are
    fixed-scale decimals (4 dp prices and z, 2 dp percentages and money), so the
    text is plain notation.
    """
    parts = _payload_parts(wf, flags, bridge, top_n)
    return parts.select(F.to_json(F.struct("waterfall", "top_outliers", "yoy_bridge")).alias("payload"))


@dataclass
class Analysis:
    """DataFrames produced by :func:`analyze` (``None`` when not requested); nothing is cached, so nothing to release."""

    action: str
    filters: TxnFilter | None = None
    waterfall: DataFrame | None = None
    outliers: DataFrame | None = None
    bridge: DataFrame | None = None
    payload: DataFrame | None = None

    @cached_property
    def error(self) -> str | None:
        """Why there is nothing to report: no rows under the filters.  Asking runs the waterfall once."""
        if self.waterfall is not None and self.waterfall.isEmpty():
            return f"no rows to analyse for {self.filters}"
        return None


#: What each action returns.
ACTION_PARTS = {
    "waterfall": {"waterfall"},
    "outliers": {"outliers"},
    "trends": {"bridge"},
    "narrative": {"waterfall", "outliers", "payload"},
    "full_analysis": {"waterfall", "outliers", "bridge", "payload"},
}

#: What the passes over a slice read: the filters' dimensions, the columns that a part requires, ratios that are there.
PASS_COLUMNS = {*S.FILTER_DIMENSIONS, *S.WATERFALL_REQUIRED, *S.PERIOD_REQUIRED, *S.OUTLIER_REQUIRED, *[m for m, _ in S.OUTLIER_METRICS]}


def analyze(
    df: DataFrame,
    action: str = "full_analysis",
    filters: TxnFilter | None = None,
    base_year: int | None = None,
    current_year: int | None = None,
    reuse: str = "none",
) -> Analysis:
    """The parts of an action (:data:`ACTION_PARTS`) over one filtered slice.

    Peer groups of the outliers are formed after filtering; the bridge compares the two
    years of the unfiltered frame and is left out without them.  A slice without a waterfall row has
    nothing to analyse: every part is then empty, the bridge that comes with a waterfall
    included, and :attr:`Analysis.error` says so.  The payload is what a
    narrative writer would receive.  The slice is read by several passes; ``reuse="write"`` writes it,
    with the rows of the bridge's years if there is a bridge and with the columns that the parts read, once
    (:func:`~pocketlens.plans.reuse.shared`), for frames that are not stored tables.
    """
    if action not in ACTION_PARTS:
        raise ValueError(f"unknown action {action!r}; expected one of {tuple(ACTION_PARTS)}")
    parts = ACTION_PARTS[action]
    out = Analysis(action=action, filters=filters)
    with_bridge = "bridge" in parts and None not in (base_year, current_year)
    if "outliers" in parts:
        kept = filter_predicate(df, filters)
        if kept is not None and with_bridge:
            kept = kept | F.col("year").isin(base_year, current_year)
        rows = df if kept is None else df.filter(kept)
        df = shared(rows if reuse == "none" else rows.select(*[c for c in df.columns if c in PASS_COLUMNS]), reuse)
    scope = apply_filters(df, filters)
    if "outliers" in parts:
        out.outliers = detect_outliers(scope)
    if "waterfall" in parts:
        out.waterfall = compute_waterfall(scope)
    if with_bridge:
        out.bridge = margin_bridge(df, base_year, current_year)
        if out.waterfall is not None:
            out.bridge = out.bridge.filter(out.waterfall.agg(F.count(F.lit(1)).alias("n")).scalar() > 0)
    if "payload" in parts:
        out.payload = insight_payload(out.waterfall, out.outliers, out.bridge)
    return out
