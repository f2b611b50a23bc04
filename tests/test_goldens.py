"""Hand-checked answers on the invented sample table."""

from __future__ import annotations

import pytest

from ledgerlens import ReportFilter
from ledgerlens.plans import reports as R


def kpi(sample, **kw):
    return R.kpi_summary(sample, ReportFilter(**kw)).collect()[0].asDict()


@pytest.mark.parametrize("kw, expected", [
    ({}, (6687, 3.58, 952.9, 6, 2, 2, 2, "2025-03-01")),
    ({"servicer_number": "Q-11"}, (417, 3.1, 64.3, 1, 0, 1, 0, "2025-03-01")),
    ({"servicer_name": "ledger"}, (512, 4.4, 76.4, 2, 0, 1, 1, "2025-03-01")),
    ({"servicer_name": "LEDGER"}, (512, 4.4, 76.4, 2, 0, 1, 1, "2025-03-01")),
    ({"end_date": "2025-02-28"}, (6734, 3.19, 958.8, 7, 4, 2, 1, "2025-02-28")),
    ({"start_date": "2025-02-28", "servicer_name": "juniper"},
     (417, 3.1, 64.3, 1, 0, 1, 0, "2025-03-01")),
    ({"servicer_number": "q-11"}, (0, 0.0, 0.0, 0, 0, 0, 0, None)),
    ({"start_date": "2025-03-02"}, (0, 0.0, 0.0, 0, 0, 0, 0, None)),
])
def test_kpi(sample, kw, expected):
    k = kpi(sample, **kw)
    got = (k["total_loans"], k["avg_delinquency_rate"], k["total_balance_usd"],
           k["servicer_count"], k["status_green"], k["status_yellow"], k["status_red"],
           k["as_of_date"])
    assert got == expected


def test_kpi_status_map(sample):
    k = R.kpi_summary(sample, None, with_status_map=True).collect()[0]
    assert k["status_counts"] == {"GREEN": 2, "YELLOW": 2, "RED": 2}


def test_delinquency_trend(sample):
    rows = R.delinquency_trend(sample).orderBy("series_ordinal", "business_date").collect()
    series = {}
    for r in rows:
        series.setdefault(r["servicer_number"], []).append((r["x"], r["y"], r["color"]))
    assert series["Q-11"] == [("2025-02-27", 2.9, "#38bdf8"), ("2025-02-28", 3.0, "#38bdf8"),
                              ("2025-03-01", 3.1, "#38bdf8")]
    expected = {"Q-12": [4.1, 4.25, 4.4], "Q-13": [2.0, 2.1, 2.2], "Q-14": [5.5, 5.6, 5.7],
                "Q-15": [2.75, 2.8, 2.85], "Q-16": [3.4, 3.3, 3.2], "Q-17": [1.2, 1.3]}
    for number, ys in expected.items():
        assert [p[1] for p in series[number]] == ys
    names = {r["servicer_number"]: r["series_name"] for r in rows}
    assert names["Q-11"] == "Q-11 — Juniper Ledger Works"


def test_trend_series_nested(sample):
    rows = R.trend_series(sample).orderBy("series_ordinal").collect()
    assert len(rows) == 7 and {(r["part"], r["first_point"]) for r in rows} == {(0, 0)}
    assert rows[0]["x"] == ["2025-02-27", "2025-02-28", "2025-03-01"]
    assert rows[3]["y"] == [5.5, 5.6, 5.7]
    assert rows[6]["color"] == R.delinquency_trend(sample).where("series_ordinal = 6").first()["color"]


def test_loan_by_region(sample):
    rows = R.loan_by_region(sample).collect()
    got = sorted((r["region"], r["servicer_number"], r["loan_count"]) for r in rows)
    assert got == [("COAST", "Q-12", 4615), ("COAST", "Q-15", 1915), ("DELTA", "Q-14", 290),
                   ("DELTA", "Q-16", 3631), ("UPLAND", "Q-11", 1241), ("UPLAND", "Q-13", 8279),
                   ("UPLAND", "Q-17", 151)]


def test_portfolio_balance(sample):
    rows = R.portfolio_balance(sample).orderBy("bar_ordinal").collect()
    assert [(r["servicer_number"], r["balance_musd"]) for r in rows] == [
        ("Q-14", 12.1), ("Q-11", 64.3), ("Q-15", 89.5), ("Q-16", 168.9), ("Q-12", 214.4),
        ("Q-13", 403.8)]
    assert rows[1]["text"] == "$64.3M"
    assert rows[0]["label"] == "Q-14 — Marlin Ledger Trust"
    assert rows[0]["title"] == "Portfolio Balance — USD Millions (as of 2025-03-01)"
    assert [r["color"] for r in rows][:2] == ["#38bdf8", "#818cf8"]


def test_status_distribution(sample):
    rows = {r["metric_status"]: r for r in R.status_distribution(sample).collect()}
    assert {k: (v["count"], round(v["share_pct"], 6)) for k, v in rows.items()} == {
        s: (2, 33.333333) for s in ("GREEN", "RED", "YELLOW")}
    assert rows["RED"]["color"] == "#ef4444"
    assert rows["GREEN"]["title"] == "Servicer Status Distribution (as of 2025-03-01)"


def test_servicer_list(sample):
    rows = R.servicer_list(sample).collect()
    assert [r["servicer_number"] for r in rows] == [f"Q-1{i}" for i in range(1, 8)]
    assert R.servicer_count(sample).collect()[0]["count"] == 7


def test_row_count_and_profile(sample):
    assert R.row_count(sample).collect()[0]["rows"] == 20
    p = R.load_profile(sample).collect()[0]
    assert (p["rows"], p["servicers"]) == (20, 7)


def test_kpi_display(sample):
    d = R.kpi_display(R.kpi_summary(sample)).collect()[0]
    assert d["total_loans_text"] == "6,687"
    assert d["avg_delinquency_text"] == "3.58%"
    assert d["total_balance_text"] == "$953M"
    d2 = R.kpi_display(R.kpi_summary(sample, ReportFilter(servicer_number="Q-11"))).collect()[0]
    assert d2["avg_delinquency_text"] == "3.1%"
    assert d2["total_balance_text"] == "$64M"
