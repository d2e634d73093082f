"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a word budget.  Whole copies of the source fill it as often as they
fit.  What remains is filled by documents counted by their exact length: a fair share of
each length first, then bounded-knapsack dynamic programming over the lengths still left
finds the sum nearest to the last part of the budget.  The chosen number of each length
is then drawn in the order of a seeded hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: The last part of a budget, in words, that dynamic programming fits.
FIT_WORDS = 16_384
#: Documents of one source and length that are ranked together.
RANK_ROWS = 10_000
#: No document is taken more often than this, and no source beyond so many times its size.
MAX_COPIES = 3


def share_out(sizes: dict[str | None, int], weights: Sequence[float], max_copies: int = MAX_COPIES) -> dict[str | None, float]:
    """Target words of each source.

    Weights go round over the sources by code point, null last.  The targets share the sum
    of all sizes; a target above ``max_copies`` times its source's size stops there and
    the excess is shared again by weight among the others.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets: dict[str | None, float] = {}
    rest, open_sources = float(sum(sizes.values())), order
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        shares = {s: rest * weight[s] / total if total else 0.0 for s in open_sources}
        full = [s for s in open_sources if shares[s] > max_copies * sizes[s]]
        if not full:
            targets |= shares
            break
        targets |= {s: float(max_copies * sizes[s]) for s in full}
        rest -= sum(max_copies * sizes[s] for s in full)
        open_sources = [s for s in open_sources if s not in targets]
    return targets


def nearest_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length, at most ``counts``, make the sum nearest to ``budget`` (below on ties)."""
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return taken
    top = 2 * budget  # a larger sum is farther away than taking nothing
    maker = np.full(top + 1, -1, np.int64)  # the item that first reached a sum
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        left, pack = min(count, top // length), 1
        while left > 0 and not reached[budget]:
            n = min(pack, left)
            weight = n * length
            new = np.flatnonzero(reached[: top + 1 - weight] & ~reached[weight:]) + weight
            maker[new] = len(items)
            reached[new] = True
            items.append((i, n))
            left, pack = left - n, pack * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = items[maker[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take once so that their words come nearest to ``budget``."""
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.copy()
    use = lengths > 0
    if budget > FIT_WORDS:
        taken[use] = [n * (budget - FIT_WORDS) // total for n in counts[use].tolist()]
        for i in np.argsort(-lengths, kind="stable").tolist():  # one more of each length while it fits
            if lengths[i] and taken[i] < counts[i] and budget - int((taken * lengths).sum()) - lengths[i] >= FIT_WORDS:
                taken[i] += 1
    rest = budget - int((taken * lengths).sum())
    order = np.random.default_rng(seed).permutation(np.flatnonzero(use))
    taken[order] += nearest_sum(lengths[order], (counts - taken)[order], rest)
    return taken


def mix_plan(docs: DataFrame, weights: Sequence[float], seed: int = 0, max_copies: int = MAX_COPIES) -> DataFrame:
    """How often each document goes into the mix.

    Returns doc_id, source, size (words; null text: 0), source_size, target (its
    source's), copies (0 to ``max_copies``) and taken (size * copies), one row for each input
    row, repeated rows included.  Null is a source of its own, sorted last; a null doc_id
    is drawn like any other.  Ties of the hash are broken by doc_id.  Empty texts have
    size 0 and are taken whenever their source's whole copies are.  The same rows and
    seed give the same result.  Only doc_id, text and source are read.

    The driver gets one row for each source.  One task fits one source: it holds the
    source's count of documents by length, never documents.
    """
    return _plan(docs, weights, seed, max_copies, [])


def _plan(docs: DataFrame, weights: Sequence[float], seed: int, max_copies: int, names: list[str]) -> DataFrame:
    """:func:`mix_plan` with the columns ``names`` of ``docs`` (whole numbers that name a row) carried along."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialise(docs.select("doc_id", "source", size.alias("size"), *names), "mix-sizes")
    by_length = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = {r["source"]: r["words"] for r in by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    targets = share_out(totals, weights, max_copies)
    budgets = {}
    for s, words in totals.items():
        budget = int(targets[s] + 0.5)
        whole = min(budget // words, max_copies) if words else 0
        budgets[s] = (whole, budget - whole * words if whole < max_copies else 0)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        whole, rest = budgets[None if pd.isna(key[0]) else key[0]]
        lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        return rows.assign(whole=whole, extra=fit_lengths(lengths, counts, rest, seed))

    plan = by_length.groupBy("source").applyInPandas(fit, "source string, size bigint, n bigint, whole int, extra bigint")
    plan = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "whole", "extra")
    order = F.xxhash64(F.lit(seed), "doc_id")
    # the upper 32 bits of the hash, as a share of all, cut a frequent length into parts of bounded size
    part = F.floor((F.shiftrightunsigned(order, 32) / F.lit(2.0**32)) * F.ceil(F.col("n") / RANK_ROWS))
    unsigned = F.shiftrightunsigned(order, 1)
    drawn = sizes.join(plan, sizes["source"].eqNullSafe(plan["p_source"]) & (sizes["size"] == plan["p_size"]))
    drawn = drawn.select("doc_id", *names, "source", "size", "whole", "extra", part.alias("part"), unsigned.alias("draw"))
    parts = drawn.groupBy("source", "size", "part").agg(F.count("*").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("source", "size").orderBy("part")) - F.col("rows")
    parts = parts.select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), earlier.alias("earlier")
    )
    drawn = drawn.join(
        parts,
        drawn["source"].eqNullSafe(parts["p_source"]) & (drawn["size"] == parts["p_size"]) & (drawn["part"] == parts["p_part"]),
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id", *names))
    copies = F.col("whole") + (F.col("earlier") + rank <= F.col("extra")).cast("int")
    drawn = drawn.select("doc_id", *names, "source", "size", copies.alias("copies"))
    shares = spark.createDataFrame(
        [(s, totals[s], float(targets[s])) for s in totals], "s_source string, source_size bigint, target double"
    )
    out = drawn.join(shares, drawn["source"].eqNullSafe(shares["s_source"]))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return out.select("doc_id", *names, "source", "size", "source_size", "target", "copies", taken)


def mix_documents(docs: DataFrame, weights: Sequence[float], seed: int = 0, max_copies: int = MAX_COPIES) -> DataFrame:
    """The documents of the mix with all their columns, then size, source_size, target, copies and taken.

    Every row of ``docs`` has its own row of the plan: repeated doc_ids, whole repeated rows and rows without
    a doc_id are drawn like any other, so the words taken are the plan's.  A row is returned
    once, with its number of copies; rows without a copy are left out.  Input columns of these names are replaced.
    Rows of equal doc_id, source and text are told apart by the hash of their other columns.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    content = [F.col(c).isNull() for c in ("doc_id", "source", "text")] + [F.col(c) for c in ("doc_id", "source", "text")]
    # 128 bits that name a row's doc_id, source and text
    named = docs.withColumns({f"mix_key_{k}": F.xxhash64(F.lit(k), *content) for k in (1, 2)})
    keys = ["mix_key_1", "mix_key_2"]
    plan = _plan(named, weights, seed, max_copies, keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("copies")))
    plan = plan.select(*[F.col(k).alias(f"plan_{k}") for k in keys], nth.alias("plan_nth"), *[F.col(c).alias(f"mixed_{c}") for c in added])
    plan = plan.filter("mixed_copies > 0")
    other = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "source", "text")] or [F.lit(0)])
    rows = named.withColumn("mix_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(other)))
    same = [rows[k] == plan[f"plan_{k}"] for k in keys] + [rows["mix_nth"] == plan["plan_nth"]]
    joined = rows.join(plan, same)
    own = [c for c in docs.columns if c not in added]
    return joined.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"mixed_{c}").alias(c) for c in added])
