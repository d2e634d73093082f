"""Latest-per-key dedup against a pandas brute force, with one key holding a third of the rows."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from pocketlens.operators.silver import DEDUP_ORDER, dedup_latest
from pocketlens.schema import NATURAL_KEY

N = 900
STRINGS = {"country", "material", "sales_designation", "sold_to", "corporate_group", "pso"}


def transactions(seed):
    rng = np.random.default_rng(seed)
    hot = np.arange(N) < N // 3
    loads = [dt.datetime(2025, 1, d) for d in range(1, 4)]  # few load times: ties are common
    std_cost = rng.uniform(20, 60, N)
    std_cost[rng.random(N) < 0.1] = np.nan
    return pd.DataFrame(
        {
            "country": np.where(hot, "A", rng.choice(["A", "B"], N)),
            "year": np.full(N, 2025),
            "material": np.where(hot, "M0", rng.choice(["M0", "M1"], N)),
            "sales_designation": np.where(hot, "STD", rng.choice(["STD", "OEM"], N)),
            "sold_to": np.where(hot, "C-0", rng.choice([f"C-{i}" for i in range(5)], N)),
            "corporate_group": rng.choice(["G1", "G2", None], N),
            "sales_qty": rng.integers(1, 4, N).astype(float),
            "blue_jobber_price": rng.uniform(50, 150, N),
            "deductions": rng.uniform(0, 10, N),
            "invoice_price": rng.uniform(40, 140, N),
            "bonuses": rng.uniform(0, 5, N),
            "pocket_price": rng.uniform(35, 135, N),
            "pso": "P",
            "standard_cost": std_cost,
            "material_cost": rng.uniform(10, 40, N),
            "_loaded_at": [loads[i] for i in rng.integers(0, 3, N)],
        }
    )


def brute_force(pdf):
    order = [c for c in DEDUP_ORDER if c not in NATURAL_KEY]
    ranked = pdf.sort_values(order, ascending=False, na_position="last", kind="mergesort")
    return ranked.groupby(NATURAL_KEY, sort=False, dropna=False).head(1)


def test_dedup_matches_brute_force_with_hot_key(spark):
    pdf = transactions(11)
    hot = dict(country="A", year=2025, material="M0", sales_designation="STD", sold_to="C-0")
    assert (pdf[NATURAL_KEY] == [hot[k] for k in NATURAL_KEY]).all(axis=1).sum() >= N // 3
    fields = []
    for c in pdf.columns:
        t = (T.StringType() if c in STRINGS else T.IntegerType() if c == "year"
             else T.TimestampNTZType() if c == "_loaded_at" else T.DoubleType())
        fields.append(T.StructField(c, t, True))
    rows = [
        tuple(
            None if isinstance(v, float) and np.isnan(v)
            else v.to_pydatetime() if isinstance(v, pd.Timestamp)
            else v.item() if hasattr(v, "item") else v
            for v in r
        )
        for r in pdf.itertuples(index=False, name=None)
    ]
    df = spark.createDataFrame(rows, T.StructType(fields)).repartition(6)

    got = dedup_latest(df).toPandas()
    want = brute_force(pdf)
    assert len(got) == len(want)
    key = NATURAL_KEY
    got = got.sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    for c in ["blue_jobber_price", "sales_qty", "standard_cost", "corporate_group", "_loaded_at"]:
        a, b = got[c], want[c]
        if c == "_loaded_at":
            a, b = pd.to_datetime(a), pd.to_datetime(b)
        assert (a.isna() == b.isna()).all(), c
        assert (a[a.notna()] == b[b.notna()]).all(), c
