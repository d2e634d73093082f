"""Report shapes: chart steps, bridge steps, payload, analysis routing."""

import json

import pytest

from pocketlens.functions.filters import TxnFilter
from pocketlens.operators.outliers import detect_outliers
from pocketlens.operators.reports import ACTION_PARTS, analyze, bridge_steps, insight_payload, waterfall_steps
from pocketlens.operators.trends import margin_bridge
from pocketlens.operators.waterfall import compute_waterfall


COST_SHARE = 0.375


def txn(year, qty, blue=64.0, ded=4.0, bon=4.0, cost=21.0, country="NO", sold_to="K1"):
    """A sale whose prices follow from list price, deduction and bonus."""
    row = {"country": country, "year": year, "material": "M7", "pso": "NORTH", "corporate_group": "G", "sold_to": sold_to}
    row |= {"sales_qty": qty, "blue_jobber_price": blue, "deductions": ded, "bonuses": bon, "standard_cost": cost}
    return row | {"invoice_price": blue - ded, "pocket_price": blue - ded - bon, "material_cost": cost * COST_SHARE}


@pytest.fixture
def routing_df(df_of):
    """Eight equal customers in each of two years, selling more in the second."""
    return df_of([txn(year, qty, sold_to=f"K{k}") for year, qty in ((2024, 30.0), (2025, 45.0)) for k in range(8)])


def test_waterfall_steps_chain(routing_df):
    steps = {r.name: r for r in waterfall_steps(compute_waterfall(routing_df)).collect()}
    assert [s for s in steps] == ["Blue Price", "Deductions", "Invoice", "Bonuses", "Pocket", "Std Cost", "Margin"]
    assert steps["Blue Price"].value - steps["Deductions"].value == pytest.approx(steps["Invoice"].value)
    assert steps["Deductions"].base == steps["Invoice"].value
    assert steps["Invoice"].value - steps["Bonuses"].value == pytest.approx(steps["Pocket"].value)
    assert steps["Pocket"].value - steps["Std Cost"].value == pytest.approx(steps["Margin"].value)
    assert steps["Margin"].pct is not None and steps["Pocket"].pct is None


def test_bridge_steps_sum(df_of):
    df = df_of([txn(2024, 100.0), txn(2025, 120.0, blue=104.0, cost=52.0)])
    b = margin_bridge(df, 2024, 2025)
    total = b.first().total_margin_change
    steps = bridge_steps(b).collect()
    assert [s.label for s in steps] == ["Price", "Deduct", "Bonus", "Cost", "Volume", "Mix"]
    assert sum(s.value for s in steps) == pytest.approx(total, abs=0.02)


def test_payload_keys_and_omission(routing_df, df_of):
    wf = compute_waterfall(routing_df)
    p = json.loads(insight_payload(wf, detect_outliers(routing_df), None).first().payload)
    assert set(p) == {"waterfall"}  # homogeneous: no outliers, no bridge
    assert len(p["waterfall"]) == 16
    b = margin_bridge(routing_df, 2024, 2025)
    p = json.loads(insight_payload(wf, None, b).first().payload)
    assert set(p) == {"waterfall", "yoy_bridge"} and len(p["yoy_bridge"]) == 11


def test_payload_top_five_ordered(df_of):
    base = [txn(2025, 100.0, sold_to=f"P{i}") for i in range(12)]
    bad = [txn(2025, 100.0, ded=30.0 + 3 * i, sold_to=f"B{i}") for i in range(4)]
    df = df_of(base + bad)
    flags = detect_outliers(df)
    p = json.loads(insight_payload(compute_waterfall(df), flags).first().payload)
    zs = [abs(o["z_score"]) for o in p["top_outliers"]]
    assert len(zs) == min(5, flags.count()) and zs == sorted(zs, reverse=True)
    assert set(p["top_outliers"][0]) == {"sold_to", "corporate_group", "metric", "value", "peer_mean", "z_score",
                                         "severity"}


def test_analyze_routing(routing_df):
    full = analyze(routing_df, "full_analysis", None, 2024, 2025)
    assert full.waterfall is not None and full.outliers is not None and full.bridge is not None
    assert full.outliers.count() == 0 and full.payload.count() == 1
    w = analyze(routing_df, "waterfall")
    assert w.outliers is None and w.bridge is None and w.payload is None
    t = analyze(routing_df, "trends", None, 2024, 2025)
    assert t.waterfall is None and t.bridge.count() == 1
    no_years = analyze(routing_df, "trends")
    assert no_years.bridge is None
    unknown_years = analyze(routing_df, "trends", None, 2019, 2020)
    assert unknown_years.bridge.count() == 0


def test_analyze_empty_is_error(routing_df):
    r = analyze(routing_df, "full_analysis", TxnFilter(country="Atlantis"), 2024, 2025)
    assert "Atlantis" in r.error
    assert all(part.count() == 0 for part in (r.waterfall, r.outliers, r.bridge, r.payload))
    assert analyze(routing_df, "full_analysis", TxnFilter(country="Atlantis"), 2024, 2025).bridge.count() == 0
    assert analyze(routing_df, "waterfall").error is None and analyze(routing_df, "trends").error is None


def test_analyze_bridge_ignores_filters(routing_df):
    r = analyze(routing_df, "full_analysis", TxnFilter(year=2025), 2024, 2025)
    assert r.bridge.count() == 1  # the filter would have removed 2024


def test_unknown_action(routing_df):
    with pytest.raises(ValueError):
        analyze(routing_df, "forecast")


@pytest.mark.parametrize("action", list(ACTION_PARTS))
@pytest.mark.parametrize("reuse", ["none", "write"])
def test_analyze_leaves_nothing_cached(spark, routing_df, action, reuse):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    r = analyze(routing_df, action, None, 2024, 2025, reuse)
    for part in (r.waterfall, r.outliers, r.bridge, r.payload):
        if part is not None:
            part.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
