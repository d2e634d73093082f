"""File sources and sinks: CSV ingest, type enforcement, bronze append, layer writes.

CSV is read with every column as a string and then conformed, so the NULL
tokens ('' / NULL / null) and type casts are explicit Column expressions.
Layer tables are rebalanced on their clustering keys before writing, so a large
year is spread over many tasks of bounded size.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.broadcast import estimated_bytes
from ..schema import BRONZE_COLUMNS, TRANSACTION_SCHEMA
from ..session import shuffles_released

log = logging.getLogger(__name__)

NULL_TOKENS = ("", "NULL", "null")
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}

# Codec of stored tables: bronze rows took 29 % fewer bytes than with Spark's default (60 copies of sf0.1).
TABLE_CODEC = "zstd"

# Clustering keys of the materialised layers: (partition column, sort columns).
LAYER_LAYOUT = {
    "bronze": ("year", ["year", "country"]),
    "silver": ("year", ["year", "country"]),
    "waterfall_fact": ("year", ["year", "country", "pso"]),
    "customer_profitability": ("year", ["year", "pso"]),
}

# Stored rows are turned into a layer in up to MAX_PASSES passes over some of the years, as many as there are PASS_BYTES.
MAX_PASSES = 8
PASS_BYTES = 64 << 20

# Columns that are filtered by equality but not sorted by: their Bloom filters (sized by the writer from
# the values met, and left out where a dictionary serves) skip row groups, as statistics do for sorted keys.
LOOKUP_COLUMNS = ["sold_to", "material", "corporate_group"]


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read headered CSV transactions and conform them to :data:`TRANSACTION_SCHEMA`.

    Columns are found by their header name, in any order and case.  Unknown, repeated
    and missing required columns are refused, and so are files whose header differs
    from the others'.
    """
    # enforceSchema=false makes every file's header be compared with the one that names the columns
    raw = spark.read.options(**CSV_OPTIONS, enforceSchema="false").csv(path)
    names = [c.strip().lower() for c in raw.columns]
    unknown = sorted(set(names) - set(BRONZE_COLUMNS))
    if unknown or len(set(names)) < len(names):
        raise ValueError(f"CSV {path}: unknown or repeated columns in header {raw.columns}")
    return conform(raw.toDF(*names))


def _null_tokens(c):
    return F.when(F.trim(c).isin(*NULL_TOKENS), F.lit(None)).otherwise(c)


def _default(field: T.StructField) -> Column | None:
    """The value of an absent column, as the source table declares it; None if it must be there."""
    if field.name in ("deductions", "bonuses"):
        return F.lit(0.0)
    if field.name == "_loaded_at":
        return F.localtimestamp()
    return F.lit(None) if field.nullable else None


def conform(df: DataFrame) -> DataFrame:
    """Lower-case names, map NULL tokens, cast to the analytic types, apply defaults, enforce NOT NULL.

    Absent ``deductions`` / ``bonuses`` default to 0, an absent ``_loaded_at`` to the
    load time, and absent nullable columns to NULL; any other absent column is refused.
    A value that does not parse, or a NULL in a NOT NULL column, fails the job when the
    row is read instead of passing silently.
    """
    df = df.toDF(*[c.lower() for c in df.columns])
    missing = [f.name for f in TRANSACTION_SCHEMA if f.name not in df.columns and _default(f) is None]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    out = []
    for field in TRANSACTION_SCHEMA.fields:
        if field.name not in df.columns:
            out.append(_default(field).cast(field.dataType).alias(field.name))
            continue
        c = F.col(field.name)
        if isinstance(df.schema[field.name].dataType, T.StringType):
            c = _null_tokens(c)
        c = c.cast(field.dataType)
        if not field.nullable and df.schema[field.name].nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"NULL in NOT NULL column {field.name}")).cast(field.dataType))
        out.append(c.alias(field.name))
    return df.select(*out)


def write_transactions_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """Write transactions as headered CSV (the format :func:`read_transactions_csv` reads, compressed or not)."""
    (
        df.select(*BRONZE_COLUMNS)
        .write.mode(mode)
        .options(header="true", quote='"', escape='"', nullValue="", timestampNTZFormat=TIMESTAMP_FORMAT, compression=compression)
        .csv(path)
    )


def write_bronze(df: DataFrame, path: str, truncate: bool = False) -> int:
    """Append (or, with ``truncate``, replace) the bronze table; return its row count."""
    conform(df).write.mode("overwrite" if truncate else "append").parquet(path, compression=TABLE_CODEC)
    return df.sparkSession.read.parquet(path).count()


def _layer_options(df: DataFrame) -> dict[str, str]:
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKUP_COLUMNS if c in df.columns}
    return blooms | {"parquet.bloom.filter.adaptive.enabled": "true", "compression": TABLE_CODEC}


def _laid_out(df: DataFrame, cluster_by: list[str], clustered: bool) -> DataFrame:
    """Rows rebalanced on the clustering keys, unless their partitions are clustered already, and sorted by them."""
    out = df if clustered else df.hint("rebalance", *[F.col(c) for c in cluster_by])
    return out.sortWithinPartitions(*cluster_by)


def write_layer(df: DataFrame, path: str, layer: str | None = None, partition_by: str | None = None,
                cluster_by: list[str] | None = None, clustered: bool = False, append: bool = False) -> None:
    """Overwrite (or, with ``append``, add to) a layer table, partitioned by year and clustered on its keys.

    Rows are rebalanced on the clustering keys: one shuffle, after which AQE sizes the
    writer tasks from the data (``spark.sql.adaptive.advisoryPartitionSizeInBytes``),
    joins small ones and splits a key value that holds a large share of the rows.
    Files are sorted by the clustering keys, so a filter on them skips row groups by their
    statistics; equality on :data:`LOOKUP_COLUMNS` skips them by dictionary or Bloom filter.
    The input is computed once.  ``clustered`` says that ``df`` is a row-wise projection of a stored table
    with these leading keys: its tasks read files that hold few keys each, so the rows are not shuffled again.
    The shuffle files go when the write ends.
    """
    if layer is not None:
        partition_by, cluster_by = LAYER_LAYOUT[layer]
    cluster_by = cluster_by or ([partition_by] if partition_by else [])
    out = df
    if cluster_by:
        out = _laid_out(out, cluster_by, clustered)
    writer = out.write.mode("append" if append else "overwrite").options(**_layer_options(out))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffles_released(df.sparkSession):
        writer.parquet(path)


def passes(stored: DataFrame) -> int:
    """In how many passes :func:`year_pass` takes a stored table, by the size of its files."""
    return max(1, min(MAX_PASSES, -(-estimated_bytes(stored) // PASS_BYTES)))


def year_pass(stored: DataFrame, number: int, of: int) -> DataFrame:
    """The rows of every ``of``-th year (NULL counts as year 0); over a table partitioned by year, other years are not read."""
    if of == 1:
        return stored
    return stored.filter(F.pmod(F.coalesce(F.col("year"), F.lit(0)), F.lit(of)) == number)


def write_rows_by_year(parts: list[DataFrame], path: str) -> DataFrame:
    """Store frames of one schema after one another, partitioned by year but not clustered; returns the stored rows."""
    with shuffles_released(parts[0].sparkSession):
        for i, df in enumerate(parts):
            df.write.mode("append" if i else "overwrite").partitionBy("year").parquet(path, compression=TABLE_CODEC)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path).select(*parts[0].columns)


def update_layer(df: DataFrame, path: str, years: DataFrame, layer: str, clustered: bool = False) -> None:
    """Replace the partitions of a layer table that the one-column frame ``years`` names by the rows of ``df`` of these years.

    Only folders of these years are written (dynamic partition overwrite); a named year without
    rows in ``df`` keeps what it has.  The layout is that of :func:`write_layer`; a table that is not there yet is begun.
    """
    partition_by, cluster_by = LAYER_LAYOUT[layer]
    changed = years.select(F.col(years.columns[0]).alias(partition_by)).distinct()
    rows = df.join(F.broadcast(changed), partition_by, "left_semi")  # a row for each year
    rows = _laid_out(rows, cluster_by, clustered)
    writer = rows.select(*df.columns).write.mode("overwrite").options(**_layer_options(df))
    with shuffles_released(df.sparkSession):
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def bronze_transactions(df: DataFrame) -> DataFrame:
    """The 16-column bronze projection (no transformation)."""
    return df.select(*BRONZE_COLUMNS)


def load_transactions(spark: SparkSession, table_path: str | None = None, csv_path: str | None = None) -> tuple[DataFrame, str]:
    """Primary parquet table, else CSV fallback; an empty source is an error.

    Returns the frame and a source label.
    """
    errors = []
    if table_path:
        try:
            df = spark.read.parquet(table_path)
            if df.isEmpty():
                raise ValueError(f"table {table_path} returned 0 rows")
            return conform(df), "table"
        except Exception as exc:  # noqa: BLE001 - any failure of the table
            errors.append(str(exc).splitlines()[0])
            log.warning("table %s not readable, falling back to CSV: %s", table_path, errors[-1])
    if csv_path:
        df = read_transactions_csv(spark, csv_path)
        if df.isEmpty():
            raise ValueError(f"CSV {csv_path} has no rows")
        return df, "csv"
    raise ValueError("no transaction source available: " + "; ".join(errors))
