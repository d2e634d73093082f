"""Sharing one input between several passes of an operator.

A parquet table scanned with column pruning and pushed filters is cheap to
read again; a computed lineage (joins, aggregations, shuffles) is not.  The
caller knows which one it holds and says so with ``reuse``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path

REUSE_MODES = ("none", "write")


def shared(df: DataFrame, reuse: str = "none") -> DataFrame:
    """Prepare ``df`` to be read by several passes.

    ``none``: every pass reads ``df`` again (for a stored table); ``write``: it is written once to the shared
    scratch folder and read from there, which cuts a long lineage.  Nothing is
    cached, so nothing has to be released and a lost executor costs no recomputation.
    """
    if reuse == "none":
        return df
    if reuse == "write":
        path = scratch_path(df.sparkSession, "slice")
        df.write.parquet(path, compression="zstd")
        return df.sparkSession.read.schema(df.schema).parquet(path)
    raise ValueError(f"unknown reuse {reuse!r}; expected one of {REUSE_MODES}")
