"""Mean and sample standard deviation that do not depend on the order of rows.

``avg`` and ``stddev_samp`` merge doubles in the order in which tasks finish, so their last
bits, and any threshold close to them, may differ from run to run.  Here each value is
put on a grid of 2^-36 and split into two whole limbs, ``x = (a * 2^25 + b) * 2^-36``; the
sums of a, b, a*a, a*b and b*b are kept in ``bigint`` halves, which add up exactly in any order and
stay in the hash aggregate's fixed buffer.  The variance is taken around the mean of the
limb ``a``, so little is lost when the totals become doubles at the end, once for each group.

Values must lie under 16,384 in magnitude (percentages do); a group with a larger one falls back to
``avg`` and ``stddev_samp``.  Up to 2^38 rows a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID_BITS, LIMB_BITS = 36, 25
LARGEST = 2.0 ** (2 * LIMB_BITS - GRID_BITS)
_LIMB = f"{float(1 << LIMB_BITS)!r}D"


def with_limbs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the limbs ``_a_<column>`` and ``_b_<column>`` (doubles holding whole numbers; NULL if too large or NULL)."""
    whole = {f"_q_{c}": F.expr(f"CASE WHEN abs({c}) < {LARGEST!r}D THEN rint({c} * {float(1 << GRID_BITS)!r}D) END") for c in columns}
    df = df.withColumns(whole)
    df = df.withColumns({f"_a_{c}": F.expr(f"CAST(floor(_q_{c} / {_LIMB}) AS DOUBLE)") for c in columns})
    return df.withColumns({f"_b_{c}": F.expr(f"_q_{c} - _a_{c} * {_LIMB}") for c in columns}).drop(*whole)


def moment_sums(columns: list[str]) -> list[Column]:
    """Aggregates over :func:`with_limbs` rows, to be read by :func:`moments`."""
    out = []
    for c in columns:
        a, b = f"_a_{c}", f"_b_{c}"
        out += [
            F.expr(f"count({c}) AS _n_{c}"),
            F.expr(f"sum(CAST({a} AS BIGINT)) AS _sa_{c}"),
            F.expr(f"sum(CAST({b} AS BIGINT)) AS _sb_{c}"),
            F.expr(f"min({c}) AS _least_{c}"),
            F.expr(f"max({c}) AS _most_{c}"),
            F.expr(f"avg({c}) AS _avg_{c}"),
            F.expr(f"stddev_samp({c}) AS _dev_{c}"),
        ]
        for name, product in (("aa", f"({a} * {a})"), ("ab", f"({a} * {b})"), ("bb", f"({b} * {b})")):
            high = f"floor({product} / {_LIMB})"
            out.append(F.expr(f"sum({high}) AS _{name}h_{c}"))
            out.append(F.expr(f"sum(CAST({product} - {high} * {_LIMB} AS BIGINT)) AS _{name}l_{c}"))
    return out


def moments(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` with ``_mean_``, ``_std_`` and ``_n_`` of each column, from a frame aggregated with :func:`moment_sums`.

    Equal values have a deviation of exactly 0; fewer than two have none.
    """
    whole = {}
    for c in columns:
        n = f"_n_{c}"
        # the limb a is taken around its rounded mean m, in exact decimals
        m = f"CAST(round(CAST(_sa_{c} AS DECIMAL(38,0)) / {n}, 0) AS DECIMAL(20,0))"
        whole[f"_m_{c}"] = F.expr(f"CASE WHEN {n} > 0 THEN {m} END")
    df = df.withColumns(whole)
    exact = {}
    for c in columns:
        n, m = f"_n_{c}", f"_m_{c}"
        square = {k: f"(CAST(_{k}h_{c} AS DECIMAL(20,0)) * {1 << LIMB_BITS} + _{k}l_{c})" for k in ("aa", "ab", "bb")}
        sa, sb = f"CAST(_sa_{c} AS DECIMAL(20,0))", f"CAST(_sb_{c} AS DECIMAL(20,0))"
        exact[f"_ca_{c}"] = F.expr(f"CAST({sa} - {n} * {m} AS DOUBLE)")
        exact[f"_caa_{c}"] = F.expr(f"CAST({square['aa']} - 2 * CAST({m} * {sa} AS DECIMAL(38,0)) + CAST({m} * {m} * {n} AS DECIMAL(38,0)) AS DOUBLE)")
        exact[f"_cab_{c}"] = F.expr(f"CAST({square['ab']} - CAST({m} * {sb} AS DECIMAL(38,0)) AS DOUBLE)")
        exact[f"_cbb_{c}"] = F.expr(f"CAST({square['bb']} AS DOUBLE)")
    df = df.withColumns(exact)
    out = []
    unit = f"{2.0**-GRID_BITS!r}D"
    for c in columns:
        n, inside = f"_n_{c}", f"greatest(abs(_least_{c}), abs(_most_{c})) < {LARGEST!r}D"
        off = f"(_ca_{c} * {_LIMB} + CAST(_sb_{c} AS DOUBLE))"  # sum of values around m, in grid units
        squares = f"(_caa_{c} * {_LIMB} * {_LIMB} + 2D * _cab_{c} * {_LIMB} + _cbb_{c})"
        mean = f"CASE WHEN _least_{c} = _most_{c} THEN _least_{c} ELSE (CAST(_m_{c} AS DOUBLE) * {_LIMB} + {off} / {n}) * {unit} END"
        std = f"CASE WHEN {n} < 2 THEN NULL WHEN _least_{c} = _most_{c} THEN 0D ELSE sqrt(greatest(0D, {squares} - {off} * {off} / {n}) / ({n} - 1)) * {unit} END"
        out.append(F.expr(f"CASE WHEN {inside} THEN {mean} ELSE _avg_{c} END").alias(f"_mean_{c}"))
        out.append(F.expr(f"CASE WHEN {inside} THEN {std} ELSE _dev_{c} END").alias(f"_std_{c}"))
        out.append(F.col(n))
    return df.select(*keep, *out)
