"""Exact-sum helper equals a decimal sum; rounding helper matches the oracle form."""

import math
import random
import statistics
import struct
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pocketlens.functions.rounding import decimal_sum, exact_sum, round_half_up

price = st.decimals(min_value=Decimal("-99999.9999"), max_value=Decimal("99999.9999"), places=4)
qty = st.decimals(min_value=Decimal("0"), max_value=Decimal("999.9999"), places=4)
EXACT_BELOW = 2e7  # products up to here carry all eight decimals


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(price, qty, st.booleans()), min_size=1, max_size=60))
@example([(Decimal("99999.9999"), Decimal("999.9999"), True)] * 3 + [(Decimal("-99999.9998"), Decimal("999.9997"), True)])
@example([(Decimal("19999.9999"), Decimal("999.9999"), True), (Decimal("-0.0001"), Decimal("0.0001"), True)])
def test_exact_sum_equals_decimal_sum(spark, rows):
    data = [(float(p) if keep else None, float(q)) for p, q, keep in rows]
    df = spark.createDataFrame(data, "p double, q double")
    got = df.agg(exact_sum(F.col("p") * F.col("q")).alias("a"), decimal_sum(F.col("p") * F.col("q")).alias("b"),
                 exact_sum(F.col("p")).alias("c"), decimal_sum(F.col("p")).alias("d")).first()
    assert got.c == got.d
    products = [p * q for p, q in data if p is not None]
    if not products:
        assert got.a is None and got.b is None
        return
    if max(map(abs, products)) < EXACT_BELOW:
        assert got.a == got.b == sum((p * q for p, q, keep in rows if keep), Decimal(0))
    # at any size: each row counts as its double, rounded at the eighth decimal
    error = Fraction(got.a) - sum(map(Fraction, products))
    assert abs(error) <= Fraction(51, 10**10) * len(products)
    assert abs(got.a - got.b) <= sum(Decimal(math.ulp(w)) + Decimal("1e-8") for w in products)
    turned = spark.createDataFrame(data[::-1], "p double, q double").repartition(3)
    assert turned.agg(exact_sum(F.col("p") * F.col("q"))).first()[0] == got.a


def test_exact_sum_order_independent(spark):
    vals = [(0.1 * i + 0.0001 * (i % 7), float(i % 13)) for i in range(2000)]
    a = spark.createDataFrame(vals, "p double, q double").repartition(7)
    b = spark.createDataFrame(list(reversed(vals)), "p double, q double").repartition(3)
    e = lambda df: df.agg(exact_sum(F.col("p") * F.col("q"))).first()[0]
    assert e(a) == e(b)


def test_round_half_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.005,), (12.344999,), (None,)], "x double")
    got = [r[0] for r in df.select(round_half_up(F.col("x"), 0)).collect()]
    assert got[:2] == [3.0, -2.0] and got[4] is None
    assert df.select(round_half_up(F.col("x"), 4)).collect()[3][0] == 12.345


@settings(max_examples=10, deadline=None)
@given(
    st.lists(st.one_of(st.integers(min_value=-50, max_value=50).map(lambda v: v / 4), st.floats(allow_nan=False)), min_size=1, max_size=80),
    st.lists(st.floats(min_value=0.0, max_value=1.0), min_size=1, max_size=4),
)
def test_exact_percentiles_match_builtin(spark, values, probs):
    from pocketlens.functions.quantiles import exact_percentiles

    df = spark.createDataFrame([(v,) for v in values], "q double")
    want = df.agg(F.percentile("q", F.array(*[F.lit(p) for p in probs]))).first()[0]
    got = exact_percentiles(df, "q", probs).first()[0]
    assert [str(v) for v in got] == [str(v) for v in want]


def test_several_columns_are_narrowed_together(spark):
    from pocketlens.functions.quantiles import exact_percentiles

    rows = [(float(i % 50), i * 0.37 - 800, None, float("nan") if i % 10 == 0 else -0.0) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, `b` double, c double, d double").repartition(5)
    got = exact_percentiles(df, ["a", "b", "c", "d"], [0.33, 0.67, 1.0]).first()
    want = df.agg(*[F.percentile(c, F.array(F.lit(0.33), F.lit(0.67), F.lit(1.0))) for c in ("a", "b")]).first()
    assert list(got[:2]) == list(want) and got.c is None
    assert got.d[:2] == [0.0, 0.0] and math.isnan(got.d[2])


def test_ordered_bits_are_the_bits_of_the_double(spark):
    from pocketlens.functions.quantiles import with_ordered_bits

    rng = random.Random(1)
    values = [0.0, -0.0, float("inf"), -float("inf"), 5e-324, 1.7976931348623157e308, 1 - 2**-53, -1e-310]
    values += [s * 2.0**e * m for e in range(-1074, 1023, 7) for m in (1, 1 - 2**-53, 1 + 2**-52) for s in (1, -1)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(500)]
    rows = with_ordered_bits(spark.createDataFrame([(v,) for v in values], "x double"), "x", "k").collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (bits if r.x > 0 else -bits), r.x


MOMENT_CASES = {
    0: lambda r: r.gauss(70, 10),
    1: lambda r: 25.000000000000004 if r.random() < 0.5 else 25.0,
    2: lambda r: 33.3,
    3: lambda r: r.gauss(-5, 1e-4),
    4: lambda r: r.gauss(0, 4000),
    5: lambda r: r.choice([16383.9, -16383.9]),
}


def test_moments_do_not_depend_on_the_order_of_rows(spark):
    from pocketlens.functions.moments import moment_sums, moments, with_limbs

    rng = random.Random(2)
    rows = [(g, MOMENT_CASES[g](rng) if rng.random() > 0.05 else None) for g in MOMENT_CASES for _ in range(700)]
    rows += [(6, 5.0), (7, None), (8, 40_000.0), (8, 40_002.0)]

    def run(df):
        sums = with_limbs(df, ["x"]).groupBy("g").agg(*moment_sums(["x"]))
        return {r.g: (r._mean_x, r._std_x, r._n_x) for r in moments(sums, ["x"], ["g"]).collect()}

    df = spark.createDataFrame(rows, "g int, x double")
    first = run(df.repartition(1))
    assert all(run(df.orderBy(F.rand(seed)).repartition(seed)) == first for seed in (2, 5, 9))
    for g, (mean, std, n) in first.items():
        values = [x for h, x in rows if h == g and x is not None]
        assert n == len(values)
        if n == 0:
            assert mean is None and std is None
            continue
        assert mean == pytest.approx(statistics.fmean(values), abs=1e-10)
        assert std is None if n < 2 else std == pytest.approx(statistics.stdev(values), abs=1e-10)
    assert first[2][1] == 0.0 and first[1][1] < 1e-9 and first[6][:2] == (5.0, None)


def test_exact_percentiles_of_nothing(spark):
    from pocketlens.functions.quantiles import exact_percentiles

    df = spark.createDataFrame([(None,), (None,)], "q double")
    assert [r[0] for r in exact_percentiles(df, "q", [0.5]).collect()] == [None]
