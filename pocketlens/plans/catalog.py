"""Registry of named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query starts from the driver tables through the adapter, so its work
grows with them.  Parameters (PSO, years) are fixed here, once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import TxnFilter
from ..functions.ratios import metric_columns
from ..functions.rounding import round_half_up
from ..operators import checks, gold, outliers, reports, silver, trends, waterfall
from ..schema import TRANSACTION_SCHEMA
from ..session import scratch_path
from ..sources import files
from ..sources.adapter import transactions_from_orders, transactions_in_parts
from ..sources.batches import BatchTable
from ..sources.footers import footer_table
from ..sources.generate import profile_transactions, tier_histogram
from . import questions as Q
from .layers import build_layers, refresh_layers, write_layer_in_passes
from .reuse import shared
from .sql import reader_session, register_views, run_readonly_sql

# Fixed parameters of the registered queries.
PSO = "EUROPE"
FILTER_COUNTRY = "NATION_7"
FILTER_YEAR = 1998
QUESTION_YEAR = 1999
BASE_YEAR = 1999
CURRENT_YEAR = 2000
LOW_MARGIN_THRESHOLD = 15.0
ORDER_YEARS = list(range(1995, 2001))  # the orders of 2001 fail the check
SEGMENT_DIMS = ["country", "pso", "year"]
READONLY_QUERY = """
SELECT pso, margin_tier, COUNT(*) AS customers, SUM(transaction_count) AS transactions
FROM customer_profitability
GROUP BY pso, margin_tier
ORDER BY pso, margin_tier
"""


@dataclass
class Layers:
    """The medallion layers over one driver directory (built lazily).

    ``tables`` may supply already materialised layers (``bronze``, ``silver``,
    ``fact``) by name, as paths or frames; missing ones are derived from the layer below.
    """

    spark: SparkSession
    sf_dir: str
    tables: dict[str, DataFrame | str] | None = None

    def _given(self, name: str) -> DataFrame | None:
        given = (self.tables or {}).get(name)
        return self.spark.read.parquet(given) if isinstance(given, str) else given

    def reuse(self, name: str) -> str:
        """How a multi-pass operator shares this layer: re-read a stored table, write a lineage once."""
        return "none" if self._given(name) is not None else "write"

    @cached_property
    def bronze(self) -> DataFrame:
        given = self._given("bronze")
        return given if given is not None else transactions_from_orders(self.spark, self.sf_dir)

    @cached_property
    def silver(self) -> DataFrame:
        given = self._given("silver")
        return given if given is not None else silver.silver_transactions(self.bronze)

    @cached_property
    def fact(self) -> DataFrame:
        given = self._given("fact")
        return given if given is not None else gold.waterfall_fact(self.silver)

    @cached_property
    def customers(self) -> DataFrame:
        return gold.customer_profitability(self.fact)

    @cached_property
    def alerts(self) -> DataFrame:
        return gold.waterfall_alerts(self.fact)


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = Layers(spark, sf_dir).bronze
    path = scratch_path(spark, "bronze-csv")
    files.write_transactions_csv(bronze, path, compression="gzip")
    return files.read_transactions_csv(spark, path)


def _bronze_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze replaced, then appended to once, read back through the source loader.

    The second load reads the rows that the first one stored, so the driver tables are joined once.
    """
    bronze = Layers(spark, sf_dir).bronze
    path = scratch_path(spark, "bronze-table")
    files.write_bronze(bronze, path, truncate=True)
    files.write_bronze(spark.read.schema(TRANSACTION_SCHEMA).parquet(path), path)
    return files.load_transactions(spark, table_path=path)[0]


def _bronze_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of the bronze rows in a batch table, the second loaded twice, as a retry does."""
    bronze = shared(Layers(spark, sf_dir).bronze, "write")  # the batches are two passes over one join
    table = BatchTable(spark, scratch_path(spark, "bronze-batches"))
    table.load(bronze.filter("year < 1998"), "to-1997", truncate=True)
    for _ in range(2):
        table.load(bronze.filter("year >= 1998"), "from-1998")
    return table.read()


def _layers_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored customer profitability, built without the last year and brought up to date with it."""
    path = scratch_path(spark, "refreshed")
    for i, rows in enumerate(transactions_in_parts(spark, sf_dir)):
        files.write_layer(rows, f"{path}/bronze", layer="bronze", append=i > 0)
    bronze = spark.read.parquet(f"{path}/bronze")
    last = bronze.agg(F.max("year")).scalar()
    built = build_layers(spark, bronze.filter(F.col("year") < last), path, passes=files.passes(bronze))
    return refresh_layers(built, bronze, bronze.filter(F.col("year") == last)).tables["customer_profitability"]


def _silver_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver written as a clustered layer table and read back.

    The joined rows are stored by year first, so the disk never holds the shuffles of the joins and of all years at once.
    """
    path = scratch_path(spark, "silver-layer")
    bronze = files.write_rows_by_year(transactions_in_parts(spark, sf_dir), scratch_path(spark, "silver-rows"))
    write_layer_in_passes(bronze, silver.silver_transactions, path, "silver", files.passes(bronze))
    return spark.read.parquet(path).select(*silver.SILVER_COLUMNS)


def _stored_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze written as a layer table, read back so that counts come from its footers."""
    path = scratch_path(spark, "bronze-layer")
    files.write_layer(Layers(spark, sf_dir).bronze, path, layer="bronze")
    return footer_table(spark, path)


def _price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p33 and p67 of a column whose values are nearly all different."""
    prices = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice")
    bounds = outliers.quantile_bounds(prices, "l_extendedprice")
    return bounds.select(*[round_half_up(F.col(f"_{p}"), 4).alias(p) for p in ("p33", "p67")])


LAYER_QUERIES: dict[str, Callable[[Layers], DataFrame]] = {}


class _q:
    """A registered query: a function of the layers, callable as ``(spark, sf_dir)``."""

    def __init__(self, fn: Callable[[Layers], DataFrame]):
        self.fn = fn

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.fn(Layers(spark, sf_dir))


def _readonly_layers(L: Layers) -> DataFrame:
    """The views registered and asked in a session of their own (the caller's, if it gave layers as frames of it)."""
    frames = any(not isinstance(t, str) for t in (L.tables or {}).values())
    own = L if frames else Layers(reader_session(L.spark), L.sf_dir, L.tables)
    register_views(own.spark, own.bronze, own.silver)
    return run_readonly_sql(own.spark, READONLY_QUERY)


def _no_detected_at(df: DataFrame) -> DataFrame:
    return df.drop("detected_at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources / layers
    "bronze_transactions": _q(lambda L: files.bronze_transactions(L.bronze)),
    "bronze_csv_roundtrip": _csv_roundtrip,
    "bronze_table_append": _bronze_append,
    "bronze_batch_table": _bronze_batches,
    "silver_layer_table": _silver_layer,
    "customer_layer_refreshed": _layers_refreshed,
    "price_percentiles": _price_percentiles,
    "silver_transactions": _q(lambda L: L.silver),
    "quality_flag_counts": _q(lambda L: L.silver.groupBy("data_quality_flag").agg(F.count(F.lit(1)).alias("rows"))),
    "waterfall_fact": _q(lambda L: L.fact),
    "waterfall_fact_view": _q(lambda L: gold.waterfall_fact_view(L.bronze)),
    "outlier_metric_columns": _q(lambda L: metric_columns(L.bronze)),
    "fact_slice": _q(lambda L: gold.fact_slice(L.fact, TxnFilter(pso=PSO, year=FILTER_YEAR))),
    # gold aggregates
    "customer_profitability": _q(lambda L: L.customers),
    "customers_by_margin": _q(lambda L: gold.customers_by_margin(L.customers)),
    "waterfall_alerts": _q(lambda L: _no_detected_at(L.alerts)),
    "active_alerts": _q(lambda L: _no_detected_at(gold.active_alerts(L.alerts))),
    "data_checks": _q(lambda L: checks.run_checks(L.fact, L.customers)),
    "dataset_status": _q(lambda L: checks.dataset_status(L.bronze, "driver tables")),
    "data_checks_years": _q(lambda L: checks.run_checks(L.fact, L.customers, ORDER_YEARS)),
    "stored_status": lambda spark, sf_dir: checks.dataset_status(_stored_bronze(spark, sf_dir), "bronze layer"),
    "stored_coverage": lambda spark, sf_dir: checks.coverage_by_year(_stored_bronze(spark, sf_dir)),
    "required_columns": lambda spark, sf_dir: checks.required_columns(_stored_bronze(spark, sf_dir)),
    "profile_transactions": _q(lambda L: profile_transactions(L.bronze)),
    "tier_histogram": _q(lambda L: tier_histogram(L.bronze)),
    # waterfall and trends
    "compute_waterfall": _q(lambda L: waterfall.compute_waterfall(L.bronze)),
    "compute_waterfall_filtered": _q(
        lambda L: waterfall.compute_waterfall(L.bronze, TxnFilter(country=FILTER_COUNTRY, year=FILTER_YEAR))
    ),
    "waterfall_by_segment": _q(lambda L: reports.with_margin_health(waterfall.waterfall_by(L.bronze, SEGMENT_DIMS))),
    "waterfall_steps": _q(lambda L: reports.waterfall_steps(waterfall.waterfall_by(L.bronze, ["pso"]), keep=["pso"])),
    "period_metrics": _q(lambda L: trends.period_metrics(L.bronze)),
    "margin_bridge": _q(lambda L: trends.margin_bridge(L.bronze, BASE_YEAR, CURRENT_YEAR, nested=False)),
    # outliers
    "volume_bands": _q(lambda L: outliers.volume_bands(L.bronze)),
    "detect_outliers": _q(lambda L: outliers.detect_outliers(L.silver, reuse=L.reuse("silver"))),
    "outlier_summary": _q(
        lambda L: outliers.summarize_outliers(outliers.detect_outliers(L.silver, reuse=L.reuse("silver")), with_band=True)
    ),
    "top_outliers": _q(lambda L: outliers.top_outliers(outliers.detect_outliers(L.silver, reuse=L.reuse("silver")), 5)),
    # ad-hoc SQL and questions
    "readonly_sql": _q(_readonly_layers),
    "q_overall_waterfall": _q(lambda L: Q.q_overall_waterfall(L.bronze)),
    "q_margin_by_country": _q(lambda L: Q.q_margin_by_country(L.bronze)),
    "q_low_margin_customers": _q(lambda L: Q.q_low_margin_customers(L.customers, PSO, LOW_MARGIN_THRESHOLD)),
    "q_margin_change": _q(lambda L: Q.q_margin_change(L.bronze, BASE_YEAR, CURRENT_YEAR)),
    "q_deduction_by_material": _q(lambda L: Q.q_deduction_by_material(L.bronze)),
    "q_top_customers_revenue": _q(lambda L: Q.q_top_customers_revenue(L.fact)),
    "q_active_alerts": _q(lambda L: _no_detected_at(Q.q_active_alerts(L.alerts))),
    "q_realization_by_pso": _q(lambda L: Q.q_realization_by_pso(L.bronze, QUESTION_YEAR)),
    "q_low_tier_groups": _q(lambda L: Q.q_low_tier_groups(L.fact)),
    "q_full_analysis": _q(lambda L: Q.q_full_analysis(L.bronze, PSO, BASE_YEAR, CURRENT_YEAR, L.reuse("bronze"))),
    "analyze_waterfall": _q(lambda L: reports.analyze(L.bronze, "waterfall", TxnFilter(pso=PSO)).waterfall),
    "analyze_outliers": _q(lambda L: reports.analyze(L.bronze, "outliers", TxnFilter(pso=PSO), reuse=L.reuse("bronze")).outliers),
    "analyze_trends": _q(
        lambda L: trends.flatten_bridge(reports.analyze(L.bronze, "trends", TxnFilter(pso=PSO), BASE_YEAR, CURRENT_YEAR).bridge)
    ),
    "analyze_narrative": _q(lambda L: reports.analyze(L.bronze, "narrative", TxnFilter(pso=PSO), reuse=L.reuse("bronze")).payload),
    "q_bonus_by_material": _q(lambda L: Q.q_bonus_by_material(L.bronze)),
    "q_deduction_by_pso": _q(lambda L: Q.q_deduction_by_pso(L.bronze, QUESTION_YEAR)),
    "q_outlier_customers": _q(lambda L: Q.q_outlier_customers(L.silver, reuse=L.reuse("silver"))),
}

LAYER_QUERIES.update({name: q.fn for name, q in QUERIES.items() if isinstance(q, _q)})
