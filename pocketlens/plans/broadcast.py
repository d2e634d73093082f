"""Joins that broadcast a side only if its measured bytes are under a bound.

The measure is part of the plan: a scalar subquery adds up the widths of the small side's
rows, and two joins are guarded by it, of which one finds its small side (broadcast) or its large side
(sort-merge, with AQE splitting skewed partitions) empty.  So nothing is counted, cached or decided while the plan
is built, nothing above the bound is ever broadcast, and the rows are not shuffled if it is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def broadcast_bytes(df: DataFrame) -> int:
    """The session's bound, ``spark.sql.autoBroadcastJoinThreshold``, in bytes (negative: never)."""
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the frame's size, from file statistics for a scan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _row_bytes(df: DataFrame) -> Column:
    """Width of a row in a hash table: 8 bytes a field, the bytes of texts, and a fixed part."""
    width = F.lit(32 + 8 * len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    return width.cast("long")


def join_measured(big: DataFrame, small: DataFrame, on: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """Inner join; ``small`` is broadcast if its rows take ``max_bytes`` (by default the session's bound) or less."""
    limit = broadcast_bytes(big) if max_bytes is None else max_bytes
    if limit < 0:
        return big.join(small, on)
    measure = F.struct(F.coalesce(F.sum(_row_bytes(small)), F.lit(0)).alias("bytes"))
    size = small.agg(measure.alias("size")).scalar().getField("bytes")  # a bare number would be compiled into each stage's code
    near = big.join(F.broadcast(small.filter(size <= limit)), on)
    far = big.filter(size > limit).join(small, on)
    return near.unionByName(far)
