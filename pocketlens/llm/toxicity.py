"""Toxicity scores by a bidirectional gated recurrent network over overlapping windows (one starts at every STRIDE-th word)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of
from .gru import Scorer, train

#: The bounded sample that the network is fitted on: rows of each label, and the longest text among them.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_000, 2_000
SAMPLE_CHARS = 20_000
UPDATES, SEED = 360, 7
#: Texts under this sum of characters are scored together.
SLICE_CHARS = 1 << 18

OUT = "held_out boolean, score double, predicted int, n_windows bigint"


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from (a null doc_id is not held out and has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of at most SAMPLE_TOXIC + SAMPLE_CLEAN documents that are not held out, by a hash of doc_id.

    Of repeated labels the largest counts; of repeated doc_ids the smallest text of up to SAMPLE_CHARS characters is taken.
    """
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    draws = [usable.filter(F.col("toxic") == y).orderBy(*order).limit(rows) for y, rows in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    draw = draws[0].unionByName(draws[1])  # bounded by the two limits
    texts = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(draw), "doc_id").groupBy("doc_id", "toxic")
    return found.agg(F.min("text").alias("text"))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))))
    labels = np.array([y for _, _, y in rows], np.int64)
    if 0 < labels.sum() < len(labels):
        model = train([t for _, t, _ in rows], labels, SEED, UPDATES)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """The pickled network fitted on :func:`labelled_sample`, in one task; None without rows of both labels.

    The sample is bounded by its rows and the longest text; the driver gets the network alone.
    """
    row = labelled_sample(docs, labels).coalesce(1).mapInArrow(_train, "model binary").first()
    return None if row is None else bytes(row["model"])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """Toxicity of every whole text.

    A document's score is that of its most toxic window: overlapping windows over all of its
    words are scored, whatever its length; one starts at every STRIDE-th word, so a run of up to
    WINDOW - STRIDE + 1 words lies whole in one of them.  Returns doc_id (or the columns ``carry``), then
    held_out, score (0 to 1), predicted (1 if score >= ``threshold``) and n_windows, one row
    for each input row, repeated rows included.  A null or empty text is one empty window;
    a null doc_id is kept.  Without labelled rows of both kinds there is nothing to learn
    and every score is 0.  Only text enters a score.
    """
    carry = carry or ["doc_id"]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value)) if shared.value is not None else None
        for batch in slices(batches, 256):
            texts = texts_of(batch)
            if scorer is None:
                scores, windows = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            else:
                parts, at = [], 0
                while at < len(texts):
                    end, chars = at + 1, len(texts[at])
                    while end < len(texts) and chars + len(texts[end]) <= SLICE_CHARS:
                        chars += len(texts[end])
                        end += 1
                    parts.append(scorer.best_logits(texts[at:end]))
                    at = end
                logits, windows = (np.concatenate(c) for c in zip(*parts))
                scores = 1 / (1 + np.exp(-logits.astype(np.float64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= threshold).astype(np.int32)),
                    pa.array(windows, pa.int64()),
                ],
                names=["row", "held_out", "score", "predicted", "n_windows"],
            )

    rows = docs.select(F.struct(*carry).alias("row"), "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {OUT}")
    added = [f.split()[0] for f in OUT.split(", ")]
    return scored.select(*[F.col("row")[c].alias(c) for c in carry if c not in added], *added)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs``, with the same columns, whose text is not predicted toxic."""
    shared_names = [c for c in docs.columns if c in ("held_out", "score", "predicted", "n_windows")]
    renamed = docs.withColumnsRenamed({c: f"own_{c}_" for c in shared_names})
    kept = score_documents(renamed, labels, threshold, renamed.columns).filter("predicted = 0")
    return kept.select(*renamed.columns).withColumnsRenamed({f"own_{c}_": c for c in shared_names})
