"""Waterfall answers worked out by hand, grouping and NULL handling."""

import pytest

from pocketlens.functions.filters import TxnFilter
from pocketlens.operators.waterfall import compute_waterfall, waterfall_by

# quantity, list price, deduction, bonus, standard cost, material cost of each sale.  With the
# quantities 10, 30 and 60 the weights are 0.1, 0.3 and 0.6: list 0.1*80 + 0.3*40 + 0.6*20 = 32,
# deduction 0.1*8 + 0.3*4 + 0.6*2 = 3.2, bonus 0.1*2 + 0.3*1 + 0.6*3 = 2.3, cost 0.1*30 + 0.3*20 + 0.6*5 = 12.
SALES = {
    "K1": ("PT", "SOUTH", 10, 80, 8, 2, 30, 11),
    "K2": ("PT", "SOUTH", 30, 40, 4, 1, 20, 7),
    "K3": ("NO", "NORTH", 60, 20, 2, 3, 5, 3),
}


def sale(sold_to, **other):
    country, pso, qty, blue, ded, bon, cost, material = SALES[sold_to]
    row = {"country": country, "year": 2024, "material": "M1", "pso": pso, "corporate_group": "G", "sold_to": sold_to}
    row |= {"sales_qty": qty, "blue_jobber_price": blue, "deductions": ded, "invoice_price": blue - ded, "bonuses": bon}
    return row | {"pocket_price": blue - ded - bon, "standard_cost": cost, "material_cost": material} | other


@pytest.fixture
def sales(df_of):
    return df_of([sale(k) for k in SALES])


def only(df):
    (row,) = df.collect()
    return row


def test_weighted_averages(sales):
    r = only(compute_waterfall(sales))
    assert (r.transaction_count, r.total_qty) == (3, 100)
    assert (r.blue_price, r.pocket_price, r.standard_cost) == (32.0, 26.5, 12.0)
    assert r.contribution_margin == 14.5
    assert r.margin_pct == pytest.approx(100 * 14.5 / 26.5, abs=0.01)
    assert r.realization_pct == pytest.approx(100 * 26.5 / 32, abs=0.01)
    assert r.realization_pct + r.leakage_pct == pytest.approx(100, abs=0.02)
    assert r.total_pocket_revenue == 2650.0


@pytest.mark.parametrize("wanted,count,qty", [({"country": "PT"}, 2, 40), ({"pso": "NORTH"}, 1, 60), ({"sold_to": "K2"}, 1, 30)])
def test_filters(sales, wanted, count, qty):
    r = only(compute_waterfall(sales, TxnFilter(**wanted)))
    assert (r.transaction_count, r.total_qty) == (count, qty)


def test_a_single_sale_keeps_its_prices(sales):
    r = only(compute_waterfall(sales, TxnFilter(sold_to="K2")))
    assert (r.blue_price, r.pocket_price, r.contribution_margin) == (40.0, 35.0, 15.0)
    assert (r.margin_pct, r.realization_pct) == (42.86, 87.5)


def test_nothing_to_weigh(sales, df_of):
    assert compute_waterfall(sales, TxnFilter(country="XX")).collect() == []
    assert compute_waterfall(df_of([sale("K1", sales_qty=0)])).collect() == []
    with pytest.raises(ValueError, match="Missing required columns"):
        compute_waterfall(df_of([{"country": "PT", "sales_qty": 1}]))


def test_filter_on_absent_column_is_skipped(sales):
    assert only(compute_waterfall(sales.drop("sold_to"), TxnFilter(sold_to="K1"))).transaction_count == 3


def test_groups_are_filters(sales):
    by = {r.country: r.asDict() for r in waterfall_by(sales, ["country"]).collect()}
    assert by.keys() == {"PT", "NO"}
    for country, row in by.items():
        assert row == {"country": country, **only(compute_waterfall(sales, TxnFilter(country=country))).asDict()}


def test_null_cost_has_no_weight(df_of):
    r = only(compute_waterfall(df_of([sale("K1"), sale("K3", standard_cost=None)])))
    assert r.standard_cost == 30.0 and r.blue_price == round((10 * 80 + 60 * 20) / 70, 4)
