"""Exact percentiles by radix selection: no sort of the rows, no merge of all distinct values.

Spark's ``percentile`` aggregate merges a map of every distinct value into one final
task.  Here a value's rank is narrowed digit by digit instead:

1. every value has a 64-bit key in the order of the values (the bits of the double);
2. a level counts, by one partial aggregate of at most 65,536 groups for each wanted
   prefix, how many keys have each next 16-bit digit, and picks the digit that
   holds the wanted rank; the next level only counts keys that begin so;
3. a rank is known when all keys of its digit are one value, after four levels at the latest.

Several percentiles of several columns are narrowed together, in the same passes.  Nothing
is cached or written.  A level is a job of one aggregate, whose at most 65,536 counts for each prefix the
driver reads; the levels nested as scalar subqueries in one lazy plan gave the same results, but
took some six times as long, most of it planning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT_BITS = 16
SHIFTS = (48, 32, 16, 0)

_TINY = "2.2250738585072014E-308D"  # smallest double with a leading one bit
_INFINITE = 2047 << 52


def with_ordered_bits(df: DataFrame, x: str, key: str) -> DataFrame:
    """Add ``key``: a bigint in the order of the double column ``x``, its bits, negated for negative values.

    -0.0 and 0.0 are equal, infinities are at the ends and NaN comes last, as in Spark's
    order; NULL stays NULL.  Plain arithmetic: the exponent from ``log2``, put right where that is off by a rounding.
    """
    half = f"{float(2**537)!r}D"
    # steps, as each is used several times by the next
    df = df.withColumn("_near", F.expr(f"least(1023, floor(log2(abs({x}))))")).withColumn("_power", F.expr("pow(2D, _near)"))
    df = df.withColumn("_off", F.expr(f"CASE WHEN abs({x}) >= 2 * _power THEN 1 WHEN abs({x}) < _power THEN -1 ELSE 0 END"))
    df = df.withColumn("_part", F.expr(f"abs({x}) / (_power * CASE _off WHEN 1 THEN 2D WHEN -1 THEN 0.5D ELSE 1D END)"))
    bits = (
        f"CASE WHEN isnan({x}) THEN {_INFINITE + 1} WHEN {x} = 0D THEN 0 "
        f"ELSE CAST(sign({x}) AS BIGINT) * CASE WHEN abs({x}) = double('infinity') THEN {_INFINITE} "
        f"WHEN abs({x}) < {_TINY} THEN CAST(abs({x}) * {half} * {half} AS BIGINT) "
        f"ELSE (_near + _off + 1023) * {1 << 52} + CAST((_part - 1D) * {float(1 << 52)!r}D AS BIGINT) END END"
    )
    return df.withColumn(key, F.expr(bits)).drop("_near", "_power", "_off", "_part")


def _keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, k, v): column number, key and value of every value that is not NULL."""
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    if len(columns) == 1:
        rows = values.select(F.lit(0).alias("c"), F.col("v0").alias("v"))
    else:
        rows = values.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in range(len(columns))])))
    return with_ordered_bits(rows.filter("v is not null"), "v", "k")


def _narrowed(keys: DataFrame, shift: int, wanted: list[dict]) -> list[dict]:
    """The wanted ranks with the next digit of their prefix; ``v`` where the value is known."""
    rows = keys
    prefixes = {(t["c"], t["prefix"]) for t in wanted if t["prefix"] is not None}
    if prefixes:
        of_column = F.lit(False)
        for c in sorted({c for c, _ in prefixes}):
            of_column |= (F.col("c") == c) & F.shiftright("k", shift + DIGIT_BITS).isin(*sorted(p for d, p in prefixes if d == c))
        rows = rows.filter(of_column)
    hist = rows.groupBy("c", F.shiftright("k", shift).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    counted: dict[tuple, list] = {}
    for r in sorted(hist.collect(), key=lambda r: (r.c, r.d)):  # at most 65,536 digits for each prefix
        counted.setdefault((r.c, r.d >> DIGIT_BITS if prefixes else None), []).append(r)
    out = []
    for t in wanted:
        digits = counted.get((t["c"], t["prefix"]), [])
        if not digits:
            continue  # a column without values
        upto = np.cumsum([r.n for r in digits])
        if t["prefix"] is None:  # first level: the rank follows from the total
            pos = float(upto[-1] - 1) * t["p"]
            t = t | {"pos": pos, "rank": math.floor(pos) if t["side"] == "floor" else math.ceil(pos)}
        at = int(np.searchsorted(upto, t["rank"], "right"))
        r = digits[at]
        known = r.most if r.least == r.most or shift == 0 else None
        out.append(t | {"rank": t["rank"] - int(upto[at] - r.n), "prefix": r.d, "v": known})
    return out


def exact_percentiles(df: DataFrame, column: str | list[str], probs: list[float]) -> DataFrame:
    """One row of exact percentiles (NULLs ignored), as ``percentile`` interpolates them.

    For one column: ``_q``, the array that ``percentile(column, array(probs))`` gives.  For a
    list of columns: an array under each column's name.  A column without values gives NULL.
    ``df`` is read once for each level, of its columns only these: pass a stored table, not a long lineage.
    """
    columns = [column] if isinstance(column, str) else list(column)
    if not columns or not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("columns and probabilities from 0 to 1 are needed")
    keys = _keys(df, columns)
    wanted = [
        {"c": c, "i": i, "p": float(p), "side": side, "prefix": None} for c in range(len(columns)) for i, p in enumerate(probs) for side in ("floor", "ceil")
    ]
    known = []
    for shift in SHIFTS:
        narrowed = _narrowed(keys, shift, wanted)
        known += [t for t in narrowed if t["v"] is not None]
        wanted = [t for t in narrowed if t["v"] is None]
        if not wanted:
            break
    at = {(t["c"], t["i"], t["side"]): t for t in known}

    def value(c: int, i: int) -> float:
        low, high = at[c, i, "floor"], at[c, i, "ceil"]
        pos = low["pos"]
        return low["v"] if pos == math.floor(pos) else (math.ceil(pos) - pos) * low["v"] + (pos - math.floor(pos)) * high["v"]

    rows = [[value(c, i) for i in range(len(probs))] if (c, 0, "floor") in at else None for c in range(len(columns))]
    names = ["_q"] if isinstance(column, str) else columns
    schema = T.StructType([T.StructField(name, T.ArrayType(T.DoubleType())) for name in names])
    # an Arrow table becomes a local relation, which no job is needed to read
    table = pa.table([pa.array([row], pa.list_(pa.float64())) for row in rows], names=names)
    return df.sparkSession.createDataFrame(table, schema)
