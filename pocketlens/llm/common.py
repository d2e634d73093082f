"""Helpers shared by the training-data operators.

Operators read only the columns they name; every other input column is ignored
unless the docstring says that it is carried through, so extra columns can have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def quoted(*path: str) -> Column:
    """A column by its exact name, or a field by the names that lead to it."""
    return F.col(".".join("`" + name.replace("`", "``") + "`" for name in path))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to at most ``rows`` rows, which bounds the Python objects alive at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def utf8_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The text column as UTF-8 bytes, null as the empty text."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back (cuts lineage, survives lost executors)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, name: str, *counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`materialise`, and aggregates over the rows that the write itself has seen (no second job)."""
    seen = Observation()
    out = materialise(df.observe(seen, *counts), name)
    return out, seen.get


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def keep_rows(docs: DataFrame, kept: DataFrame, id_column: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``kept`` (unique, in ``id_column``), one row for each doc_id.

    Rows without a doc_id stay, as no decision can name them.  The row number reuses
    the join's partitioning and order, so texts are shuffled once.
    """
    names = docs.columns
    named = docs.filter("doc_id is not null")
    joined = named.join(kept, named["doc_id"] == kept[id_column])
    first = F.row_number().over(Window.partitionBy(named["doc_id"]).orderBy(named["doc_id"]))
    joined = joined.select(*[named[c] for c in names], first.alias("row_of_id_"))
    return joined.filter("row_of_id_ = 1").select(*names).unionByName(docs.filter("doc_id is null"))


def rolling_hashes(codes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all runs of the given sizes, put together from runs of powers of two."""
    with np.errstate(over="ignore"):
        runs, size, power = {1: codes.astype(np.uint64) + np.uint64(1)}, 1, {1: np.uint64(0x9E3779B97F4A7C15)}
        while size * 2 <= max(sizes):
            h = runs[size]
            runs[size * 2] = h[:-size] * power[size] + h[size:]
            power[size * 2] = power[size] * power[size]
            size *= 2
        out = {}
        for want in sizes:
            at, h = 0, None
            for bit in reversed(range(want.bit_length())):
                part = 1 << bit
                if want & part:
                    piece = runs[part][at:]
                    h = piece if h is None else h[: len(piece)] * power[part] + piece
                    at += part
            out[want] = h[: len(codes) - want + 1]
        return out
