"""Peer z-scores against a closed form, flags, bands and report shapes.

n rows at one value and one at another: the odd row lies n / sqrt(n + 1) sample
deviations from the mean, whatever the two values are.  So n = 3 gives 1.5 (no flag),
n = 5 gives 2.04 (MEDIUM from 1.8) and n = 8 gives 2.67 (HIGH from 2.5).
"""

import math

import pytest

from pocketlens.operators.outliers import detect_outliers, summarize_outliers, top_outliers, volume_bands


def sale(who, ded=6.0, bon=3.0, cost=20.0, **other):
    prices = {"blue_jobber_price": 60.0, "deductions": ded, "invoice_price": 60.0 - ded, "bonuses": bon}
    prices |= {"pocket_price": 60.0 - ded - bon, "standard_cost": cost, "material_cost": cost / 2}
    place = {"country": "PT", "year": 2024, "material": "M1", "pso": "SOUTH", "corporate_group": "G", "sold_to": who}
    return place | {"sales_qty": 40.0} | prices | other


def group(n, **odd):
    """n equal sales and a different one."""
    return [*(sale(f"even{k}") for k in range(n)), sale("odd", **odd)]


def flags(df_of, rows, **kw):
    return {(r.sold_to, r.metric): r for r in detect_outliers(df_of(rows), **kw).collect()}


@pytest.mark.parametrize("n,severity", [(3, None), (5, "MEDIUM"), (8, "HIGH"), (20, "HIGH")])
def test_z_table(df_of, n, severity):
    got = flags(df_of, group(n, cost=45.0))  # only the margin differs
    if severity is None:
        assert got == {}
    else:
        assert got.keys() == {("odd", "margin_pct")}
        r = got["odd", "margin_pct"]
        assert r.severity == severity and r.z_score == pytest.approx(-n / math.sqrt(n + 1), abs=0.01)
        assert r.peer_group == f"M1|PT|{r.volume_band}"


@pytest.mark.parametrize(
    "odd,metrics",
    [
        ({"ded": 24.0}, {"deduction_pct", "margin_pct", "bonus_pct", "realization_pct"}),
        ({"cost": 45.0}, {"margin_pct"}),
        ({"cost": 1.0}, set()),  # a better margin is no fault
        ({}, set()),
    ],
)
def test_which_metrics_are_flagged(df_of, odd, metrics):
    assert {m for _, m in flags(df_of, group(9, **odd))} <= metrics
    assert bool(flags(df_of, group(9, **odd))) == bool(metrics)


def test_rows_without_a_score(df_of):
    rows = group(9, cost=45.0)
    assert flags(df_of, rows + [sale("none", sales_qty=0.0, cost=59.0)]).keys() == {("odd", "margin_pct")}
    assert flags(df_of, [sale("a"), sale("b", ded=50.0)]) == {}  # a group too small
    with pytest.raises(ValueError, match="Missing required columns"):
        detect_outliers(df_of([{"country": "PT", "sales_qty": 1.0}]))


def test_null_price_is_no_outlier_and_moves_no_peer(df_of):
    rows = group(9, cost=45.0)
    want = flags(df_of, rows)
    got = flags(df_of, rows + [sale("unknown", pocket_price=None)])
    assert got.keys() == want.keys()
    assert got["odd", "margin_pct"].z_score == want["odd", "margin_pct"].z_score


def test_arguments_and_given_columns(df_of):
    rows = group(9, cost=45.0)
    assert flags(df_of, rows, z_threshold_high=9.0, z_threshold_med=8.0) == {}
    given = [dict(r, margin_pct=50.0) for r in rows[:-1]] + [dict(rows[0], sold_to="given", margin_pct=2.0)]
    assert flags(df_of, given).keys() == {("given", "margin_pct")}
    out = detect_outliers(df_of([dict(r, line=float(k)) for k, r in enumerate(rows)]), keys=["line"])
    assert out.columns[0] == "line" and {r.line for r in out.collect()} == {9.0}


def test_reports(df_of):
    rows = [*(sale(f"even{k}") for k in range(14)), *(sale(f"odd{k}", cost=44.0 + 2 * k) for k in range(3))]
    found = detect_outliers(df_of(rows), z_threshold_high=2.0, z_threshold_med=1.0)
    by_size = sorted((abs(r.z_score) for r in found.collect()), reverse=True)
    assert len(by_size) == 3
    assert [abs(r.z_score) for r in top_outliers(found, 2).collect()] == by_size[:2]
    assert [abs(r.z_score) for r in summarize_outliers(found).collect()] == by_size
    assert summarize_outliers(detect_outliers(df_of(rows[:14]))).count() == 0


def test_volume_bands(df_of):
    def bands(values):
        return {r.sales_qty: r.volume_band for r in volume_bands(df_of([{"sales_qty": v} for v in values])).collect()}

    # 0, 1, ... 100: the 33rd and 67th percentiles are 33 and 67, and an edge belongs to the band below
    got = bands([float(v) for v in range(101)])
    assert [got[v] for v in (0.0, 33.0, 34.0, 67.0, 68.0, 100.0)] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
    assert bands([4.0] * 6) == {4.0: "MEDIUM"}
