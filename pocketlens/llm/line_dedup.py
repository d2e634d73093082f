"""Incremental line dedup that can be undone: sharded cuckoo filters before exact reference tables.

The index of a set of documents has three tables, all in the shared scratch folder:

* ``references``: one row for each document and different line key in it (the exact table),
* ``repeated``: reference count, first and last document of each key that several documents hold,
* ``filters``: for each shard of keys the cuckoo filter of all its keys.

Inserting documents deals their keys to the shards.  A key that its filter does not know
and that comes once is certainly new and needs no look at the exact tables; the others
are counted exactly from the references.  Deleting documents takes their references
away, counts the touched keys anew, and removes a filter entry when no key of its class
is left, so an index after a deletion equals one that never held the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, quoted, slices, utf8_of
from .cuckoo import CuckooFilter, classes_of

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS = 10
#: Keys of a shard, about, when an index is begun.
SHARD_KEYS = 100_000
#: Keys that a shard's task holds before it drops repeats among them.
HELD_KEYS = 500_000

KEY = ["hi", "lo"]
REFERENCES = "hi bigint, lo bigint, class bigint, doc_id bigint, kind int"
#: Kinds of references: alone in its slice of documents, the first of several there, the others of these.
ALONE, FIRST, OTHER = 0, 1, 2


@dataclass(frozen=True)
class LineIndex:
    references: DataFrame
    repeated: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped line of an A-Z lower-cased text; None for a key of too few code points."""
    key = line.strip(SPACE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _references(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, owners = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8_of(batch)):
                own = {line_key(line, min_chars) for line in text.lower().split(b"\n")} - {None}
                keys.extend(own)
                owners.extend([doc_id] * len(own))
            words = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            same, count = np.unique(words, axis=0, return_inverse=True, return_counts=True)[1:] if len(words) else (np.empty(0, int),) * 2
            same = same.ravel()
            kind = np.where(count[same] > 1, OTHER, ALONE)
            kind[(np.unique(same, return_index=True)[1])] = np.where(count > 1, FIRST, ALONE)
            hi, lo = np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1])
            columns = [pa.array(hi), pa.array(lo), pa.array(classes_of(lo)), pa.array(owners, pa.int64()), pa.array(kind.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "class", "doc_id", "kind"])

    return run


def references_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document and different line key in it.  Rows without a doc_id or text give none."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    return rows.mapInArrow(_references(min_chars), REFERENCES)


class _Shard:
    """A shard's filter while its new keys stream by; holds the different keys, not the rows."""

    def __init__(self, shard: int, data: bytes | None):
        self.shard, self.filter = shard, CuckooFilter(data=data)
        self.keys, self.seen = [np.empty((0, 3), np.int64)], [np.empty(0, np.int64)]
        self.held = 0

    def add(self, hi: np.ndarray, lo: np.ndarray, classes: np.ndarray, several: np.ndarray) -> None:
        different, count = np.unique(classes, return_counts=True)
        self.seen += [classes[self.filter.holds(classes) | several], different[count > 1]]
        self.filter.insert(different)
        self.keys.append(np.column_stack([hi, lo, classes]))
        self.held += len(hi)
        if self.held > HELD_KEYS:
            self.keys = [np.unique(np.concatenate(self.keys), axis=0)]
            self.seen = [np.unique(np.concatenate(self.seen))]
            self.held = 0

    def rows(self) -> pa.RecordBatch:
        keys = np.concatenate(self.keys)
        keys = keys[np.isin(keys[:, 2], np.concatenate(self.seen))]
        keys = np.unique(keys[:, :2], axis=0) if len(keys) else keys[:, :2]
        n = len(keys)
        columns = [
            pa.array([self.shard] * (n + 1), pa.int32()),
            pa.array(np.r_[keys[:, 0], 0]),
            pa.array(np.r_[keys[:, 1], 0]),
            pa.array([None] * n + [self.filter.to_bytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "hi", "lo", "filter"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: the filter row first, then new keys; out come the keys perhaps seen before and the filter with all."""
    shard = None
    for batch in batches:
        at, hi, lo, classes, kind = (batch.column(c).fill_null(0).to_numpy() for c in ("shard", "hi", "lo", "class", "kind"))
        data = batch.column("filter")
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist() + [len(at)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if shard is None or shard.shard != at[a]:
                if shard is not None:
                    yield shard.rows()
                shard = _Shard(int(at[a]), data[a].as_py())
                a += data[a].is_valid
            if a < b:
                shard.add(hi[a:b], lo[a:b], classes[a:b], kind[a:b] == FIRST)
    if shard is not None:
        yield shard.rows()


def _forget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: the filter row first, then classes of which no key is left; out comes the filter without them."""
    shard, kept = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kept.to_bytes()], pa.binary())], names=["shard", "filter"])

    for batch in slices(batches, 4096):
        classes = batch.column("class").fill_null(-1).to_numpy()
        for i, (at, data) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("filter").to_pylist())):
            if data is not None:
                if kept is not None:
                    yield row()
                shard, kept = at, CuckooFilter(data=data)
            else:
                kept.delete(classes[i : i + 1])
    if kept is not None:
        yield row()


def _shard(shards: int):
    return F.pmod("hi", F.lit(shards).cast("long")).cast("int").alias("shard")


def _at_filters(filters: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """Rows dealt by shard, each behind the filter of its shard."""
    both = filters.unionByName(rows, allowMissingColumns=True)
    return both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("filter").isNull())


def _count(references: DataFrame, keys: DataFrame) -> DataFrame:
    """Reference count, first and last document of the given keys that several documents hold."""
    held = references.join(keys, KEY, "left_semi").groupBy(*KEY)
    counts = held.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return counts.filter("first < last")


def insert(docs: DataFrame, index: LineIndex | None = None, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
    """The index with ``docs`` added; without an index, a new one.

    ``docs`` has doc_id and text; other columns are ignored.  Rows of the same doc_id are one
    document (each row is a reference).  Rows without a doc_id are never indexed.  Keys are
    lines without white space ([\\x20\\x09-\\x0D]) at both ends, A-Z lower-cased, of at least ``min_chars``
    code points, known by 128-bit hashes.
    """
    spark = docs.sparkSession
    new = materialise(references_of(docs, index.min_chars if index else min_chars), "line-references")
    if index is None:
        shards = max(1, -(-new.count() // shard_keys))
        nothing = spark.createDataFrame([], "shard int, filter binary")
        old_repeated = spark.createDataFrame([], "hi bigint, lo bigint, n bigint, first bigint, last bigint")
        index = LineIndex(new.limit(0), old_repeated, nothing, shards, min_chars)
        references = new
    else:
        references = index.references.unionByName(new)
    keys = new.filter(F.col("kind") != OTHER).select(_shard(index.shards), "hi", "lo", "class", "kind")
    dealt = _at_filters(index.filters, keys, index.shards).select("shard", "hi", "lo", "class", "kind", "filter")
    probed = materialise(dealt.mapInArrow(_probe, "shard int, hi bigint, lo bigint, filter binary"), "line-probes")
    perhaps = probed.filter("filter is null").select(*KEY)
    untouched = index.repeated.join(perhaps, KEY, "left_anti")
    repeated = materialise(untouched.unionByName(_count(references, perhaps)), "line-repeats")
    filters = probed.filter("filter is not null").select("shard", "filter")
    return LineIndex(references, repeated, filters, index.shards, index.min_chars)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of ``doc_ids`` (column doc_id; unknown and null ids are ignored)."""
    ids = doc_ids.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct()
    gone = materialise(index.references.join(ids, "doc_id", "left_semi").select("hi", "lo", "class").distinct(), "line-gone")
    left = materialise(index.references.join(ids, "doc_id", "left_anti").select(*index.references.columns), "line-references")
    touched = gone.select(*KEY)
    untouched = index.repeated.join(touched, KEY, "left_anti")
    repeated = materialise(untouched.unionByName(_count(left, touched)), "line-repeats")
    dead = gone.select(_shard(index.shards), "class").distinct()
    dead = dead.join(left.select(_shard(index.shards), "class"), ["shard", "class"], "left_anti")
    dealt = _at_filters(index.filters, dead, index.shards).select("shard", "class", "filter")
    filters = materialise(dealt.mapInArrow(_forget, "shard int, filter binary"), "line-filters")
    return LineIndex(left, repeated, filters, index.shards, index.min_chars)


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, lines, dropped = [], [], []
            keys = zip(*(batch.column(c).to_pylist() for c in KEY))
            for text, (hi, lo) in zip(utf8_of(batch), keys):
                rows = text.split(b"\n")
                lines.append(len(rows))
                if hi:
                    gone = {np.array(key, np.int64).tobytes() for key in zip(hi, lo)}
                    rows = [row for row in rows if line_key(row.lower(), min_chars) not in gone]
                    text = b"\n".join(rows)
                dropped.append(lines[-1] - len(rows))
                kept.append(text)
            columns = [batch.column("row"), pa.array(kept, pa.binary()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "kept", "n_lines", "n_dropped"])

    return run


def clean(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` with ``text`` less the lines that a document of smaller doc_id holds too, n_lines and n_dropped.

    The documents must be in the index.  Of a key that several documents hold, the lines of the smallest
    doc_id stay, all of them, and the others go; one row for each input row, repeated
    rows included.  A null text is one empty line.  Rows without a doc_id stay whole.  Columns of ``docs`` named
    n_lines or n_dropped are replaced.
    """
    repeated = index.repeated.select(*KEY, "first")
    later = index.references.join(repeated, KEY).filter("doc_id > first")
    gone = later.groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_list("hi").alias("hi"), F.collect_list("lo").alias("lo"))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id_"), "text")
    joined = rows.join(gone, rows["id_"] == gone["of_doc"], "left").select("row", "text", "hi", "lo")
    schema = T.StructType([joined.schema["row"], *T.StructType.fromDDL("kept binary, n_lines bigint, n_dropped bigint").fields])
    out = joined.mapInArrow(_rewrite(index.min_chars), schema)
    out = out.withColumn("text", F.col("kept").cast("string"))
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("text") if c == "text" else quoted("row", c) for c in order], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """:func:`clean` of ``docs`` under an index of just these documents."""
    return clean(docs, insert(docs, min_chars=min_chars, shard_keys=shard_keys))
