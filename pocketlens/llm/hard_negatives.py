"""Hard-negative mining: rows of another label that score nearly as high as an anchor's positives.

Rows are dealt by their hash to blocks of about ``TREE_ROWS`` rows, each block's cover
tree is built once and stored, and anchors visit every tree: first for their best rows of
the same label, then, with the scores of these positives known over all trees, for the
best rows of other labels in each positive's window of scores.  A task holds one tree and
a batch of anchors at a time, whatever the number of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .cover_tree import CoverTree

#: Rows of a tree, about.
TREE_ROWS = 8192
#: Squared norms from here on have no exact inner products in doubles.
EXACT = float(1 << 53)

ROWS = "vec_id bigint, label bigint, vector binary"
HITS = "anchor_id bigint, slot int, score bigint, vec_id bigint"


def _whole_vectors(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keep, data = [], []
            column = batch.column("embedding")
            for i in range(batch.num_rows):
                values = column[i].values
                if values is None or values.null_count:
                    continue
                vector = np.floor(scale * values.to_numpy().astype(np.float64))
                if np.isfinite(vector).all() and vector @ vector < EXACT:
                    keep.append(i)
                    data.append(vector.tobytes())
            rows = batch.select(["vec_id", "label"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], names=["vec_id", "label", "vector"])

    return run


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector) of the rows that can take part, components as floor(scale * x).

    Rows with a null vec_id, label or vector, a null or non-finite component, or (after
    scaling) a squared norm of 2**53 or more, whose products would not be exact, take no part.
    Of repeated vec_ids the row of the smallest label, then vector, stays.
    """
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.filter("vec_id is not null and label is not null and embedding is not null")
    rows = rows.mapInArrow(_whole_vectors(scale), ROWS)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    width = max((len(v) // 8 for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v)
    return out


def _build(leaf: int | None = None):
    def tree(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        order = np.argsort(ids)
        vectors = _matrix(rows.column("vector").to_pylist())
        built = CoverTree.build(ids[order], labels[order], vectors[order], **({"leaf": leaf} if leaf else {}))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([built.to_bytes()], pa.binary())], names=["block", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist() + [len(blocks)]
            for a, b in zip(edges, edges[1:]):
                if held and blocks[a] != now:
                    yield tree(now, held)
                    held = []
                now = int(blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield tree(now, held)

    return run


def build_trees(rows: DataFrame, tree_rows: int = TREE_ROWS, leaf: int | None = None) -> tuple[DataFrame, int]:
    """(block, tree) with the serialised tree of each block of rows, and the number of blocks."""
    blocks = max(1, -(-rows.count() // tree_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    dealt = rows.select(block.alias("block"), "*").repartition(blocks, "block").sortWithinPartitions("block")
    return materialise(dealt.mapInArrow(_build(leaf), "block int, tree binary"), "cover-trees"), blocks


def _search(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, block = None, None
        for batch in slices(batches, 1024):
            out = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("block", "tree", "vec_id", "label", "vector", "lows", "highs"))
            for at, data, anchor, label, vector, lows, highs in zip(*columns):
                if data is not None:  # a block's tree comes before its anchors
                    tree, block = CoverTree.from_bytes(data), at
                elif at == block:
                    lows = np.array([-np.inf] if lows is None else lows, float)
                    highs = np.array([np.inf] if highs is None else highs, float)
                    found = tree.search(np.frombuffer(vector), label, same, anchor, lows, highs, k)
                    for slot, (scores, ids) in enumerate(found):
                        out[0].extend([anchor] * len(ids))
                        out[1].extend([slot] * len(ids))
                        out[2].extend(int(s) for s in scores)
                        out[3].extend(ids.tolist())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["anchor_id", "slot", "score", "vec_id"])

    return run


def _best(anchors: DataFrame, trees: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """The first ``k`` hits of each anchor and window over all trees."""
    at = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    visits = anchors.select("vec_id", "label", "vector", "lows", "highs", at.alias("block"))
    both = trees.unionByName(visits, allowMissingColumns=True)
    dealt = both.repartition(blocks, "block").sortWithinPartitions("block", F.col("tree").isNull())
    hits = dealt.mapInArrow(_search(k, same), HITS)
    first = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    ratio: tuple[int, int] = (80, 100),
    scale: int = 256,
    tree_rows: int = TREE_ROWS,
    leaf: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, embedding and label; other columns are ignored.  A row's score is its inner
    product with the anchor, components floored to whole numbers after scaling (a vector
    shorter than another ends in zeros); higher scores come first, ties by smaller vec_id.  Rows of which
    ``anchor`` (a condition on vec_id) holds are anchors; an anchor's positives are its first ``positives`` other rows
    of the same label.  Each positive gets the first ``negatives`` rows of other labels whose
    score lies between ``ratio`` times the positive's score and that score, so a negative positive score gets none.
    :func:`whole_vectors` says which rows take part.  No rows, or no anchors, give no result.
    """
    rows = materialise(whole_vectors(rows, scale), "whole-vectors")
    trees, blocks = build_trees(rows, tree_rows, leaf)
    anchors = rows.filter(anchor)
    none = F.lit(None).cast("array<bigint>")
    found = _best(anchors.select("*", none.alias("lows"), none.alias("highs")), trees, blocks, positives, same=True)
    found = materialise(found.select("anchor_id", "rank", "score", "vec_id"), "positives")
    part, whole = ratio
    low = F.expr(f"CAST(CEIL(CAST(score AS DECIMAL(38,0)) * {part} / {whole}) AS BIGINT)")
    windows = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), F.col("score").alias("high")))).alias("w"))
    wanted = anchors.join(windows, anchors["vec_id"] == windows["anchor_id"])
    wanted = wanted.select("vec_id", "label", "vector", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    hits = _best(wanted, trees, blocks, negatives, same=False)
    hits = hits.select("anchor_id", (F.col("slot") + 1).alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("anchor_id", F.col("rank").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hits.join(named, ["anchor_id", "of"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
