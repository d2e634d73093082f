"""Branch fixtures for the silver and gold layers (one row per CASE branch)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pocketlens.functions.classify import margin_tier
from pocketlens.functions.ratios import ratio_columns
from pocketlens.operators.checks import dataset_status, run_checks
from pocketlens.operators.gold import (
    active_alerts,
    customer_profitability,
    customers_by_margin,
    segment_averages,
    waterfall_alerts,
    waterfall_fact,
    waterfall_fact_view,
)
from pocketlens.operators.silver import dedup_latest, silver_transactions

T0 = dt.datetime(2025, 1, 1)


def row(**kw):
    base = dict(country="USA", year=2025, material="M1", sales_designation="OEM", sold_to="C1",
                corporate_group="G1", sales_qty=10.0, blue_jobber_price=100.0, deductions=10.0, invoice_price=90.0,
                bonuses=5.0, pocket_price=85.0, pso="Americas", standard_cost=50.0, material_cost=30.0, _loaded_at=T0)
    base.update(kw)
    return base


def test_quality_flags_each_branch(df_of):
    rows = [
        row(sold_to="inv", invoice_price=95.0, pocket_price=90.0),
        row(sold_to="pocket", pocket_price=80.0),
        row(sold_to="matcost", material_cost=60.0),
        row(sold_to="zerocost", standard_cost=0.0, material_cost=0.0),
        row(sold_to="negpocket", deductions=10.0, invoice_price=90.0, bonuses=95.0, pocket_price=-5.0,
            standard_cost=1.0, material_cost=0.5),
        row(sold_to="valid"),
        row(sold_to="two", invoice_price=95.0, pocket_price=90.0, material_cost=60.0),
        row(sold_to="nullmat", material_cost=None),
    ]
    got = {r.sold_to: (r.data_quality_flag, r.material_cost) for r in silver_transactions(df_of(rows)).collect()}
    assert got["inv"][0] == "INVOICE_MISMATCH"
    assert got["pocket"][0] == "POCKET_MISMATCH"
    assert got["matcost"][0] == "MATERIAL_COST_EXCEEDS_STANDARD"
    assert got["zerocost"][0] == "ZERO_OR_NEGATIVE_COST"
    assert got["negpocket"][0] == "NEGATIVE_POCKET_PRICE"
    assert got["valid"][0] == "VALID"
    assert got["two"][0] == "INVOICE_MISMATCH"  # first match wins
    assert got["nullmat"] == ("VALID", 0.0)  # NULL falls through, then defaults to 0


def test_dedup_latest_and_ties(df_of):
    rows = [
        row(_loaded_at=T0, sales_qty=1.0),
        row(_loaded_at=T0 + dt.timedelta(days=2), sales_qty=2.0),
        row(_loaded_at=T0 + dt.timedelta(days=1), sales_qty=3.0),
        row(sold_to="tie", _loaded_at=T0, sales_qty=4.0),
        row(sold_to="tie", _loaded_at=T0, sales_qty=5.0),
    ]
    got = {r.sold_to: r.sales_qty for r in dedup_latest(df_of(rows)).collect()}
    assert got == {"C1": 2.0, "tie": 5.0}


def test_dedup_invalid_newest_row_dropped_before_ranking(df_of):
    rows = [row(_loaded_at=T0, sales_qty=7.0), row(_loaded_at=T0 + dt.timedelta(days=1), sales_qty=0.0),
            row(_loaded_at=T0 + dt.timedelta(days=2), sales_qty=None)]
    got = silver_transactions(df_of(rows)).collect()
    assert [r.sales_qty for r in got] == [7.0]


def test_dedup_idempotent(df_of):
    rows = [row(sold_to=f"C{i % 3}", _loaded_at=T0 + dt.timedelta(days=i), sales_qty=float(i + 1)) for i in range(9)]
    once = dedup_latest(df_of(rows))
    twice = dedup_latest(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


@pytest.mark.parametrize(
    "margin,tier",
    [(35.01, "Tier 1 - Premium"), (35.0, "Tier 2 - Healthy"), (25.0, "Tier 3 - Acceptable"),
     (15.0, "Tier 4 - Low"), (5.0, "Tier 5 - Destructive"), (None, "Tier 5 - Destructive")],
)
def test_margin_tier_edges(spark, margin, tier):
    df = spark.createDataFrame([(margin,)], "m double")
    assert df.select(margin_tier(F.col("m"))).first()[0] == tier


def test_ratio_guards(df_of):
    rows = [row(sold_to="zero", pocket_price=0.0, invoice_price=0.0), row(sold_to="neg", pocket_price=-5.0)]
    df = df_of(rows)
    null_g = {r.sold_to: r for r in ratio_columns(df, guard="null", scale=2).collect()}
    pos_g = {r.sold_to: r for r in ratio_columns(df, guard="positive", scale=None).collect()}
    nz_g = {r.sold_to: r for r in ratio_columns(df, guard="nonzero", scale=None).collect()}
    assert null_g["zero"].margin_pct is None and null_g["zero"].bonus_pct is None
    assert pos_g["zero"].margin_pct == 0.0 and pos_g["neg"].margin_pct == 0.0
    assert nz_g["zero"].margin_pct == 0.0 and nz_g["neg"].margin_pct == pytest.approx((-5 - 50) / -5 * 100)


def test_fact_measures(df_of):
    f = waterfall_fact(silver_transactions(df_of([row()]))).first()
    assert f.contribution_margin == 35.0 and f.margin_pct == 41.18 and f.deduction_pct == 10.0
    assert f.bonus_pct == 5.56 and f.realization_pct == 85.0 and f.leakage_pct == 15.0
    assert f.conversion_cost == 20.0 and f.pocket_revenue == 850.0 and f.margin_dollars == 350.0


def test_fact_view_keeps_all_rows_with_positive_qty(df_of):
    v = waterfall_fact_view(df_of([row(), row(sold_to="z", sales_qty=0.0)]))
    assert v.count() == 1 and "leakage_pct" in v.columns and "_loaded_at" in v.columns


def test_customer_profitability_weighted(df_of):
    rows = [row(sales_qty=10.0), row(sales_designation="D2", sales_qty=30.0, pocket_price=80.0, bonuses=10.0)]
    c = customer_profitability(waterfall_fact(silver_transactions(df_of(rows)))).first()
    assert c.transaction_count == 2 and c.total_qty == 40.0
    assert c.total_pocket_revenue == 850.0 + 2400.0
    assert c.wavg_margin_pct == round((350.0 + 900.0) / 3250.0 * 100, 2)
    assert c.margin_tier == "Tier 1 - Premium"


def _seg(df_of, **kw):
    return df_of([row(**kw)])


def alert_of(df_of, **kw):
    rows = waterfall_alerts(waterfall_fact(silver_transactions(_seg(df_of, **kw)))).collect()
    return (rows[0].alert_type, rows[0].severity) if rows else None


def test_alert_branches(df_of):
    assert alert_of(df_of, standard_cost=80.0, material_cost=40.0) == ("CRITICAL_MARGIN", "HIGH")
    assert alert_of(df_of, standard_cost=72.0, material_cost=40.0) == ("LOW_MARGIN", "MEDIUM")
    assert alert_of(df_of, deductions=20.0, invoice_price=80.0, pocket_price=75.0, standard_cost=40.0,
                    material_cost=20.0) == ("HIGH_DEDUCTIONS", "HIGH")
    assert alert_of(df_of, bonuses=9.0, pocket_price=81.0, standard_cost=40.0,
                    material_cost=20.0) == ("HIGH_BONUSES", "MEDIUM")
    # inconsistent arithmetic: small deduction and bonus, yet pocket is far below blue
    assert alert_of(df_of, deductions=5.0, invoice_price=95.0, bonuses=5.0, pocket_price=60.0, standard_cost=30.0,
                    material_cost=10.0) == ("LOW_REALIZATION", "MEDIUM")
    assert alert_of(df_of, standard_cost=40.0, material_cost=20.0) is None


def test_alert_averages_are_unweighted(df_of):
    rows = [row(sales_qty=1.0, deductions=10.0), row(sales_designation="D2", sales_qty=1000.0, deductions=20.0,
                                                     invoice_price=80.0, pocket_price=75.0)]
    s = segment_averages(waterfall_fact(silver_transactions(df_of(rows)))).first()
    assert s.avg_deduction_pct == 15.0 and s.transaction_count == 2


def test_active_alert_order(df_of):
    rows = [row(country="A", standard_cost=72.0), row(country="B", standard_cost=80.0),
            row(country="C", deductions=20.0, invoice_price=80.0, pocket_price=75.0, standard_cost=40.0)]
    fact = waterfall_fact(silver_transactions(df_of(rows)))
    order = [(r.country, r.severity) for r in active_alerts(waterfall_alerts(fact)).collect()]
    assert order == [("B", "HIGH"), ("C", "HIGH"), ("A", "MEDIUM")]


def test_customers_by_margin_nulls_last(df_of):
    rows = [row(sold_to="a", standard_cost=60.0), row(sold_to="b", pocket_price=0.0, invoice_price=5.0,
                                                      bonuses=5.0, deductions=95.0), row(sold_to="c")]
    got = [r.sold_to for r in customers_by_margin(customer_profitability(waterfall_fact(
        silver_transactions(df_of(rows))))).collect()]
    assert got == ["a", "c", "b"]


def test_checks_and_status(df_of):
    fact = waterfall_fact(silver_transactions(df_of([row(), row(sold_to="c2", year=1999)])))
    checks = {(r.table_name, r.column_name, r.check_name): r.failures
              for r in run_checks(fact, customer_profitability(fact)).collect()}
    assert len(checks) == 14
    assert checks[("waterfall_fact", "year", "accepted_values")] == 1
    assert sum(checks.values()) == 1
    st = dataset_status(df_of([row(), row()]), "unit").first()
    assert (st.status, st.data_source, st.row_count) == ("ok", "unit", 2)
