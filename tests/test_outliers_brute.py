"""Peer-group outliers against a pandas brute force, with one peer group holding a third of the rows.

Both join paths are exercised: the measured broadcast of the peer statistics
and the sort-merge join used beyond the byte bound.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from pocketlens import schema as S
from pocketlens.operators.outliers import detect_outliers

N = 600


def transactions(seed):
    rng = np.random.default_rng(seed)
    hot = np.arange(N) < N // 3  # one (material, country, quantity) holds a third of all rows
    blue = rng.uniform(50, 150, N)
    ded = blue * np.where(rng.random(N) < 0.03, rng.uniform(0.35, 0.45, N), rng.uniform(0.05, 0.2, N))
    inv = blue - ded
    bon = inv * rng.uniform(0.02, 0.09, N)
    pocket = inv - bon
    std_cost = pocket * np.where(rng.random(N) < 0.03, rng.uniform(0.95, 1.05, N), rng.uniform(0.5, 0.8, N))
    return pd.DataFrame(
        {
            "id": np.arange(N, dtype="int64"),
            "country": np.where(hot, "A", rng.choice(["A", "B"], N)),
            "year": np.full(N, 2025, dtype="int32"),
            "material": np.where(hot, "M0", rng.choice(["M0", "M1", "M2"], N)),
            "pso": "P",
            "corporate_group": "G",
            "sold_to": [f"C-{i}" for i in range(N)],
            "sales_qty": np.where(hot, 50.0, rng.integers(0, 100, N).astype(float)),  # includes qty 0 rows
            "blue_jobber_price": blue,
            "deductions": ded,
            "invoice_price": inv,
            "bonuses": bon,
            "pocket_price": pocket,
            "standard_cost": std_cost,
            "material_cost": std_cost * 0.6,
        }
    )


def round4(x):
    return np.floor(x * 10000.0 + 0.5) / 10000.0


def brute_force(pdf):
    d = pdf[pdf.sales_qty > 0].copy()

    def ratio(num, den):
        return np.where(den != 0, num / np.where(den != 0, den, 1.0) * 100.0, 0.0)

    d["margin_pct"] = ratio(d.pocket_price - d.standard_cost, d.pocket_price)
    d["deduction_pct"] = ratio(d.deductions, d.blue_jobber_price)
    d["bonus_pct"] = ratio(d.bonuses, d.invoice_price)
    d["realization_pct"] = ratio(d.pocket_price, d.blue_jobber_price)
    p33, p67 = np.percentile(d.sales_qty, [33, 67])
    q = d.sales_qty
    band = np.where(p33 == p67, "MEDIUM", np.where(q <= p33, "LOW", np.where(q <= p67, "MEDIUM", "HIGH")))
    d["peer_group"] = d.material + "|" + d.country + "|" + band
    out = {}
    for metric, direction in S.OUTLIER_METRICS:
        g = d.groupby("peer_group")[metric]
        mean, std, n = g.transform("mean"), g.transform("std"), g.transform("count")
        z = ((d[metric] - mean) / std).where((n >= S.MIN_PEER_SIZE) & (std > S.STD_EPSILON))
        hit = z <= -S.MED_Z if direction == "low_is_bad" else z >= S.MED_Z
        for i, zi, pg in zip(d.id[hit], z[hit], d.peer_group[hit]):
            out[(int(i), metric)] = (round4(zi), "HIGH" if abs(zi) >= S.HIGH_Z else "MEDIUM", pg)
    return out


def spark_flags(spark, pdf, **kw):
    schema = T.StructType(
        [
            T.StructField(c, T.LongType() if c == "id" else T.IntegerType() if c == "year"
                          else T.DoubleType() if pdf[c].dtype == float else T.StringType())
            for c in pdf.columns
        ]
    )
    df = spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), schema).repartition(4)
    flags = detect_outliers(df, keys=["id"], **kw)
    rows = flags.collect()
    plan = flags._jdf.queryExecution().executedPlan().toString()
    return {(r.id, r.metric): (r.z_score, r.severity, r.peer_group) for r in rows}, plan


def assert_same(got, want):
    assert set(got) == set(want)
    for k, (z, sev, pg) in want.items():
        gz, gsev, gpg = got[k]
        assert abs(gz - z) <= 1e-4 + 1e-9 and gsev == sev and gpg == pg, k


@pytest.mark.parametrize("seed", [1, 7])
def test_outliers_match_brute_force_broadcast(spark, seed):
    pdf = transactions(seed)
    want = brute_force(pdf)
    assert want, "fixture should produce flags"
    assert max(sum(1 for (i, _), v in want.items() if v[2] == "M0|A|" + b) for b in S.VOLUME_BANDS) > 0
    hot = pdf[(pdf.material == "M0") & (pdf.country == "A") & (pdf.sales_qty == 50.0)]
    assert len(hot) >= N // 3
    got, plan = spark_flags(spark, pdf)
    assert "BroadcastHashJoin [peer_group" in plan
    assert_same(got, want)


def test_outliers_match_brute_force_sort_merge(spark):
    """Statistics over the byte bound: the branch with the broadcast finds its small side empty."""
    pdf = transactions(3)
    for bound in (-1, 0):
        got, plan = spark_flags(spark, pdf, max_broadcast_bytes=bound)
        assert "SortMergeJoin [peer_group" in plan
        assert_same(got, brute_force(pdf))


def test_flags_are_the_same_bits_for_any_order_of_the_rows(spark):
    pdf = transactions(5)
    whole = [spark_flags(spark, pdf.sample(frac=1, random_state=seed))[0] for seed in (1, 2, 3)]
    assert whole[0] and whole[0] == whole[1] == whole[2]
