"""Bronze loads that can be repeated safely: staged files and a log of committed batches.

A table folder holds ``data/<batch>-<attempt>`` folders of Parquet files and a log, ``_log/<number>.json``.
A load writes its files first, which nobody sees, checks their row count, and then commits by
creating the next log entry; creation fails if another load took that number, and the
load looks again.  A batch id that the log names is not loaded twice, and a load that fails leaves
nothing that a reader would see.  ``truncate`` commits an entry that all earlier ones are behind.

Prices and quantities are DECIMAL(18,4) at rest, as the source declares them; a value that does not fit
fails the load.  Readers get doubles, which are the same as before storing for
values of four decimals.

Files are reached through Hadoop's file system interface, so any store that Spark can write to will do, if it
creates files exclusively.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import BRONZE_COLUMNS, MEASURE_COLUMNS, STORAGE_DECIMAL, TRANSACTION_SCHEMA
from .files import TABLE_CODEC, conform

_BATCH = re.compile(r"[A-Za-z0-9._-]{1,100}")


class LoadError(RuntimeError):
    """The staged files do not hold what was written; nothing was committed."""


@dataclass(frozen=True)
class BatchLoad:
    """What a load did: ``appended`` is False if the batch had been committed before."""

    batch_id: str
    rows: int
    appended: bool


class BatchTable:
    """A bronze table at ``path`` that is loaded batch by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _log(self) -> list[dict]:
        """Committed entries in order."""
        folder = self._paths(f"{self.path}/_log")
        if not self._files.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self._files.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return [self._entry(f"{self.path}/_log/{name}") for name in names]

    def _entry(self, path: str) -> dict:
        stream = self._files.open(self._paths(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def batches(self) -> list[dict]:
        """The entries a reader sees: batch, folder, rows; none before the last truncating one."""
        log = self._log()
        start = max((i for i, e in enumerate(log) if e["truncate"]), default=0)
        return log[start:]

    def _commit(self, entry: dict) -> bool:
        """Append to the log; False if the batch is there already (another attempt was faster)."""
        while True:
            log = self._log()
            if any(e["batch"] == entry["batch"] for e in log):
                return False
            target = self._paths(f"{self.path}/_log/{len(log):020d}.json")
            try:
                stream = self._files.create(target, False)
            except Py4JJavaError as exc:
                if self._files.exists(target):
                    continue  # the number is taken: look again
                raise exc
            try:
                stream.write(bytearray(json.dumps(entry).encode()))
            finally:
                stream.close()
            return True

    def load(self, df: DataFrame, batch_id: str, truncate: bool = False) -> BatchLoad:
        """Append (or, with ``truncate``, replace the table by) the rows of ``df`` under ``batch_id``.

        The same id appends once, however often it is loaded.  An empty frame commits an empty batch.
        """
        if not _BATCH.fullmatch(batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, '.', '_' and '-' only")
        known = next((e for e in self._log() if e["batch"] == batch_id), None)
        if known is not None:
            return BatchLoad(batch_id, known["rows"], False)
        folder = f"data/{batch_id}-{uuid.uuid4().hex[:12]}"
        seen = Observation()
        at_rest(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{folder}", compression=TABLE_CODEC)
        rows = seen.get["rows"]
        stored = self.spark.read.parquet(f"{self.path}/{folder}").count()  # from the files' footers
        if stored != rows:
            raise LoadError(f"batch {batch_id}: {rows} rows written, {stored} stored")
        if not self._commit({"batch": batch_id, "folder": folder, "rows": rows, "truncate": truncate}):
            return BatchLoad(batch_id, next(e["rows"] for e in self._log() if e["batch"] == batch_id), False)
        return BatchLoad(batch_id, rows, True)

    def read(self) -> DataFrame:
        """All committed rows, in the analytic types; a table without batches has none."""
        folders = [f"{self.path}/{e['folder']}" for e in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], TRANSACTION_SCHEMA)
        return analytic(self.spark.read.parquet(*folders))

    def row_count(self) -> int:
        """Rows of the table, from the log alone."""
        return sum(e["rows"] for e in self.batches())


def at_rest(df: DataFrame) -> DataFrame:
    """Conformed rows with measures as DECIMAL(18,4); a value out of its range or not finite fails when it is read."""
    df = conform(df)
    limit = 10.0 ** (STORAGE_DECIMAL.precision - STORAGE_DECIMAL.scale)
    out = []
    for c in BRONZE_COLUMNS:
        if c in MEASURE_COLUMNS:
            bad = F.col(c).isNotNull() & ~(F.abs(F.col(c)) < limit)
            stored = F.when(bad, F.raise_error(F.concat(F.lit(f"{c} does not fit {STORAGE_DECIMAL.simpleString()}: "), F.col(c).cast("string"))))
            out.append(stored.otherwise(F.col(c).cast(STORAGE_DECIMAL)).cast(STORAGE_DECIMAL).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def analytic(df: DataFrame) -> DataFrame:
    """Stored rows with measures as doubles."""
    return df.select(*[F.col(c).cast(TRANSACTION_SCHEMA[c].dataType).alias(c) for c in BRONZE_COLUMNS])
