"""Stored Parquet tables whose counts and extremes come from file footers.

The table is read through the v2 Parquet source with aggregate pushdown: ``count(*)``,
``count(column)`` and ``min`` / ``max`` of numbers, for the whole table or by all of its
partition columns, are answered from the footers of the files, and no column is read.
Any other query over the same frame reads its columns as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import reader_session

V1_SOURCES = "spark.sql.sources.useV1SourceList"


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application, and with its SQL settings, that answers aggregates from Parquet footers."""
    own = reader_session(spark)
    sources = [s for s in own.conf.get(V1_SOURCES).split(",") if s.strip() and s.strip() != "parquet"]
    own.conf.set(V1_SOURCES, ",".join(sources))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``; the caller's session keeps its settings.

    Files must carry column statistics, as those that Spark writes do.
    """
    return footer_session(spark).read.parquet(path)
