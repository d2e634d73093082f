"""Materialise the medallion layers as tables (the batch build of the gold layer).

bronze -> silver (dedup + quality flag) -> waterfall_fact -> customer_profitability
and waterfall_alerts.  Each layer is written once with its clustering layout and
read back, so later layers and queries scan files instead of recomputing the
lineage, and a lost executor only re-runs the step it was working on.  Every layer's keys hold the year,
so a large stored bronze is taken some years at a time, and the disk holds the shuffles of one pass.  The fact has a
row for each valid silver row and the same leading keys, so it is written from silver's files without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gold import customer_profitability, waterfall_alerts, waterfall_fact
from ..operators.silver import silver_transactions
from ..sources.files import update_layer, write_layer, year_pass

LAYER_ORDER = ("silver", "waterfall_fact", "customer_profitability", "waterfall_alerts")


@dataclass
class BuiltLayers:
    paths: dict[str, str]
    tables: dict[str, DataFrame]


def build_layers(spark: SparkSession, bronze: DataFrame, root: str, layers: tuple[str, ...] = LAYER_ORDER, passes: int = 1) -> BuiltLayers:
    """Write the requested layers under ``root`` (overwrite) and return them re-read.

    ``passes`` over some years each read ``bronze`` as often, so more than one is for a stored table.
    """
    root = root.rstrip("/")
    paths: dict[str, str] = {}
    tables: dict[str, DataFrame] = {"bronze": bronze}

    def write(name: str, below: DataFrame, derive: Callable[[DataFrame], DataFrame], clustered: bool = False) -> DataFrame:
        paths[name] = f"{root}/{name}"
        write_layer_in_passes(below, derive, paths[name], name, passes, clustered)
        tables[name] = spark.read.parquet(paths[name])
        return tables[name]

    silver = write("silver", bronze, silver_transactions)
    if "waterfall_fact" in layers or "customer_profitability" in layers or "waterfall_alerts" in layers:
        fact = write("waterfall_fact", silver, waterfall_fact, clustered=True)
        if "customer_profitability" in layers:
            write("customer_profitability", fact, customer_profitability)
        if "waterfall_alerts" in layers:
            paths["waterfall_alerts"] = f"{root}/waterfall_alerts"
            waterfall_alerts(fact).write.mode("overwrite").parquet(paths["waterfall_alerts"])
            tables["waterfall_alerts"] = spark.read.parquet(paths["waterfall_alerts"])
    return BuiltLayers(paths, tables)


def write_layer_in_passes(below: DataFrame, derive: Callable[[DataFrame], DataFrame], path: str, layer: str, passes: int, clustered: bool = False) -> None:
    """Overwrite a layer by what ``derive`` makes of the layer below, whose rows of one year give rows of that year, some years a pass."""
    for i in range(passes):
        write_layer(derive(year_pass(below, i, passes)), path, layer=layer, clustered=clustered, append=i > 0)


def refresh_layers(built: BuiltLayers, bronze: DataFrame, new_rows: DataFrame) -> BuiltLayers:
    """Bring stored layers up to date after ``new_rows`` were added to ``bronze`` (which holds them).

    Every layer's keys hold the year, so only the years of the new rows can change: silver, fact and
    customer profitability are recomputed for these years and only their partitions are
    written.  The alerts, one row for each segment, are written anew from the fact.
    """
    spark = bronze.sparkSession
    years = new_rows.select("year").distinct()
    part = bronze.join(F.broadcast(years), "year", "left_semi").select(*bronze.columns)
    update_layer(silver_transactions(part), built.paths["silver"], years, "silver")
    tables = dict(built.tables, bronze=bronze, silver=_read(spark, built.paths["silver"]))
    if "waterfall_fact" in built.paths:
        update_layer(waterfall_fact(tables["silver"]), built.paths["waterfall_fact"], years, "waterfall_fact", clustered=True)
        tables["waterfall_fact"] = _read(spark, built.paths["waterfall_fact"])
    if "customer_profitability" in built.paths:
        update_layer(customer_profitability(tables["waterfall_fact"]), built.paths["customer_profitability"], years, "customer_profitability")
        tables["customer_profitability"] = _read(spark, built.paths["customer_profitability"])
    if "waterfall_alerts" in built.paths:
        waterfall_alerts(tables["waterfall_fact"]).write.mode("overwrite").parquet(built.paths["waterfall_alerts"])
        tables["waterfall_alerts"] = _read(spark, built.paths["waterfall_alerts"])
    return BuiltLayers(built.paths, tables)


def _read(spark: SparkSession, path: str) -> DataFrame:
    spark.catalog.refreshByPath(path)  # partitions were replaced under the same name
    return spark.read.parquet(path)
