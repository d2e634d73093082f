"""Peer-group z-score outliers.

Peers are rows sharing material, country and volume band (LOW / MEDIUM / HIGH
by the 33rd and 67th percentiles of quantity).  Each of four metrics is scored
on its own: a row is flagged when its z-score within the peer group breaches
the metric's bad tail (``z <= -1.8`` for low-is-bad, ``z >= 1.8`` for
high-is-bad); ``|z| >= 2.5`` is HIGH, otherwise MEDIUM.  Groups with fewer than
three rows, or with zero spread, are not scored.

Plan: (1) the two percentiles by radix selection over the quantities; (2) one
``groupBy(peer_group)`` for mean, sample std and count of all four metrics at once, exact in any
order of the rows (combined map-side, so a hot peer group costs one row per task in the shuffle);
(3) the statistics joined back, broadcast if their measured bytes allow it; (4) rows without any breach are dropped
*before* the four metrics are unpivoted, so the expansion only touches flagged
rows.  Rows are never sorted or shuffled by peer group unless the statistics are too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.classify import z_band
from ..functions.filters import require_columns
from ..functions.moments import moment_sums, moments, with_limbs
from ..functions.quantiles import exact_percentiles
from ..functions.ratios import metric_columns
from ..functions.rounding import round_half_up
from ..plans.broadcast import join_measured
from ..plans.reuse import shared

FLAG_COLUMNS = [
    "sold_to",
    "corporate_group",
    "country",
    "pso",
    "material",
    "year",
    "sales_qty",
    "volume_band",
    "peer_group",
    "metric",
    "value",
    "peer_mean",
    "peer_std",
    "z_score",
    "severity",
    "direction",
]
SUMMARY_COLUMNS = [
    "sold_to",
    "corporate_group",
    "country",
    "pso",
    "material",
    "year",
    "metric",
    "value",
    "peer_mean",
    "z_score",
    "severity",
    "peer_group",
]


def quantile_bounds(df: DataFrame, column: str = "sales_qty", method: str = "exact", accuracy: int = 100_000) -> DataFrame:
    """One row ``(_p33, _p67)``: linear-interpolated percentiles of ``column``.

    ``method="exact"`` (default) gives the same values as ``percentile`` by radix selection
    (:func:`~pocketlens.functions.quantiles.exact_percentiles`), so no task
    merges all distinct values.  ``"approx"`` uses ``percentile_approx``.
    """
    lo, hi = S.VOLUME_BAND_QUANTILES
    probs = F.array(F.lit(lo), F.lit(hi))
    if method == "exact":
        q = exact_percentiles(df, column, [lo, hi])
        return q.select(F.col("_q")[0].cast("double").alias("_p33"), F.col("_q")[1].cast("double").alias("_p67"))
    if method == "approx":
        q = F.percentile_approx(F.col(column), probs, accuracy)
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.agg(q.alias("_q")).select(
        F.col("_q")[0].cast("double").alias("_p33"), F.col("_q")[1].cast("double").alias("_p67")
    )


def volume_bands(df: DataFrame, column: str = "sales_qty", method: str = "exact", output: str = "volume_band") -> DataFrame:
    """Add a LOW / MEDIUM / HIGH band: right-closed cuts at p33 and p67.

    When p33 == p67 every row is MEDIUM.  NULL quantities get a NULL band.
    The one-row bounds are read as a scalar subquery bound to a column, so the rows are not joined with anything.
    """
    low, medium, high = S.VOLUME_BANDS
    bounds = quantile_bounds(df, column, method).select(F.struct("_p33", "_p67")).scalar()
    q, p33, p67 = F.col(column), F.col("_bounds._p33"), F.col("_bounds._p67")
    band = (
        F.when(q.isNull(), F.lit(None).cast("string"))
        .when(p33 == p67, F.lit(medium))
        .when(q <= p33, F.lit(low))
        .when(q <= p67, F.lit(medium))
        .otherwise(F.lit(high))
    )
    return df.withColumn("_bounds", bounds).withColumn(output, band).drop("_bounds")


def peer_statistics(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample std and count of each metric per peer group, in one aggregation.

    The same bits for any order and partitioning of the rows (:mod:`~pocketlens.functions.moments`).
    """
    sums = with_limbs(rows.select("peer_group", *metrics), metrics).groupBy("peer_group").agg(*moment_sums(metrics))
    return moments(sums, metrics, ["peer_group"])


def detect_outliers(
    df: DataFrame,
    z_threshold_high: float = S.HIGH_Z,
    z_threshold_med: float = S.MED_Z,
    min_peer_size: int = S.MIN_PEER_SIZE,
    keys: list[str] | None = None,
    quantile_method: str = "exact",
    max_broadcast_bytes: int | None = None,
    reuse: str = "none",
) -> DataFrame:
    """One row per (transaction, metric) breach.

    Output: ``keys`` (caller's row identifiers, if any) then sold_to,
    corporate_group, country, pso, material, year, sales_qty, volume_band,
    peer_group, metric, value, peer_mean, peer_std, z_score (4 dp), severity,
    direction.  Metric columns already on ``df`` are used as given; missing ones
    are derived with the nonzero guard.  The peer group key concatenates with
    ``|`` and is NULL when a part is NULL (such rows are not scored).

    The input is read by several passes (percentiles, peer statistics, scoring); pass
    ``reuse="write"`` unless it is a stored table (:func:`~pocketlens.plans.reuse.shared`).  Nothing is cached.
    """
    require_columns(df, S.OUTLIER_REQUIRED)
    keys = [k for k in (keys or []) if k not in FLAG_COLUMNS]
    metrics = [m for m, _ in S.OUTLIER_METRICS]
    base = metric_columns(df.filter(F.col("sales_qty") > 0))
    needed = [*keys, *[c for c in FLAG_COLUMNS[:7]], *metrics]
    rows = shared(base.select(*needed), reuse)
    rows = volume_bands(rows, method=quantile_method)
    rows = rows.withColumn(
        "peer_group", F.concat(F.col("material"), F.lit("|"), F.col("country"), F.lit("|"), F.col("volume_band"))
    )
    rows = rows.select(*keys, *[c for c in FLAG_COLUMNS[:9]], *metrics)
    stats = peer_statistics(rows, metrics)
    scored = join_measured(rows, stats, "peer_group", max_broadcast_bytes)

    z_cols: dict[str, Column] = {}
    breaches = []
    for m, direction in S.OUTLIER_METRICS:
        mean, std, n = F.col(f"_mean_{m}"), F.col(f"_std_{m}"), F.col(f"_n_{m}")
        z = F.when((n >= min_peer_size) & (std > F.lit(S.STD_EPSILON)), (F.col(m) - mean) / std)
        z_cols[f"_z_{m}"] = z
        breaches.append(_breach(F.col(f"_z_{m}"), direction, z_threshold_med))
    scored = scored.withColumns(z_cols)
    any_breach = breaches[0]
    for b in breaches[1:]:
        any_breach = any_breach | b
    flagged_rows = scored.filter(any_breach)

    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).alias("value"),
                F.col(f"_mean_{m}").alias("peer_mean"),
                F.col(f"_std_{m}").alias("peer_std"),
                F.col(f"_z_{m}").alias("z"),
                F.lit(direction).alias("direction"),
            )
            for m, direction in S.OUTLIER_METRICS
        ]
    )
    long = flagged_rows.select(*keys, *FLAG_COLUMNS[:9], F.inline(entries))
    low_dir = S.OUTLIER_METRICS[0][1]
    z = F.col("z")
    breach = F.when(F.col("direction") == low_dir, z <= -z_threshold_med).otherwise(z >= z_threshold_med)
    long = long.filter(z.isNotNull() & breach)
    high, medium = S.SEVERITY_ORDER
    return long.select(
        *keys,
        *FLAG_COLUMNS[:10],
        round_half_up(F.col("value"), 4).alias("value"),
        round_half_up(F.col("peer_mean"), 4).alias("peer_mean"),
        round_half_up(F.col("peer_std"), 4).alias("peer_std"),
        round_half_up(z, 4).alias("z_score"),
        F.when(F.abs(z) >= z_threshold_high, F.lit(high)).otherwise(F.lit(medium)).alias("severity"),
        "direction",
    )


def _breach(z: Column, direction: str, z_med: float) -> Column:
    if direction == "low_is_bad":
        return F.coalesce(z <= -z_med, F.lit(False))
    return F.coalesce(z >= z_med, F.lit(False))


def _outlier_order(flags: DataFrame) -> list[Column]:
    """|z| descending, then a total order over the identifying columns."""
    tie = [c for c in ("sold_to", "metric", "material", "country", "year", "sales_qty", "value", "pso", "corporate_group") if c in flags.columns]
    return [F.abs(F.col("z_score")).desc(), *[F.col(c).asc_nulls_last() for c in tie]]


def summarize_outliers(flags: DataFrame, with_band: bool = False) -> DataFrame:
    """The 12 summary columns ordered by |z| descending (optionally the z display band)."""
    cols = [F.col(c) for c in SUMMARY_COLUMNS]
    if with_band:
        cols.append(z_band(F.col("z_score")).alias("z_band"))
    return flags.orderBy(*_outlier_order(flags)).select(*cols)


def top_outliers(flags: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest |z| flags (a top-k: planned as TakeOrderedAndProject)."""
    return flags.orderBy(*_outlier_order(flags)).limit(n)
