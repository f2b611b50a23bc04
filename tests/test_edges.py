"""Edge tables of SURVEY 2.11: nulls, empty input, renames, many servicers, ties."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlens import ReportFilter, apply_filters, parse_date
from ledgerlens.functions import py_round
from ledgerlens.plans import reports as R
from ledgerlens.schema import METRICS_SCHEMA, PALETTE
from tests.fixtures import D1, D2, D3, frame, row


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], METRICS_SCHEMA)


def test_empty_input(empty):
    k = R.kpi_summary(empty).collect()[0]
    assert (k["total_loans"], k["avg_delinquency_rate"], k["total_balance_usd"],
            k["servicer_count"], k["as_of_date"]) == (0, 0.0, 0.0, 0, None)
    assert R.portfolio_balance(empty).count() == 0
    assert R.status_distribution(empty).count() == 0
    assert R.delinquency_trend(empty).count() == 0
    sc = {r["metric_status"]: r["count"] for r in R.kpi_status_counts(empty).collect()}
    assert sc == {"GREEN": 0, "YELLOW": 0, "RED": 0}


def test_name_filter_literal_vs_regex(spark):
    df = frame(spark, [row(1, "A", "Iris (US) Co"), row(2, "B", "Bay.Loans"),
                       row(3, "C", "Crest[1]"), row(4, "D", None)])
    lit = lambda s: sorted(r[0] for r in apply_filters(df, ReportFilter(servicer_name=s))
                           .select("unique_id").collect())
    assert lit("iris (us)") == [1]
    assert lit(".") == [2]
    assert lit("[") == [3]
    rx = lambda s: sorted(r[0] for r in apply_filters(
        df, ReportFilter(servicer_name=s, name_regex=True)).select("unique_id").collect())
    assert rx("iris (us)") == []
    assert rx(".") == [1, 2, 3]
    with pytest.raises(ValueError):
        ReportFilter(servicer_name="[", name_regex=True)
    # whitespace-only name keeps every non-null name
    assert lit("   ") == [1, 2, 3]


def test_normalised_filter():
    f = ReportFilter(servicer_number="", servicer_name="  iris ", start_date="", end_date=None)
    n = f.normalised()
    assert n == ReportFilter(servicer_name="iris")
    assert ReportFilter(servicer_name="   ").normalised().servicer_name is None
    assert ReportFilter().is_empty()


@pytest.mark.parametrize("bad", ["2026-13-01", "abc", "04/02/2026x", "13/02/2026"])
def test_bad_dates_raise_at_plan_time(bad):
    with pytest.raises(ValueError):
        ReportFilter(start_date=bad)


def test_date_parsing():
    assert parse_date("2026-04-02") == date(2026, 4, 2)
    assert parse_date("20260402") == date(2026, 4, 2)
    assert parse_date("2026-04-02T13:45:00") == date(2026, 4, 2)
    assert parse_date("04/02/2026") == date(2026, 4, 2)
    assert parse_date("April 2 2026") == date(2026, 4, 2)
    assert parse_date("Apr 2, 2026") == date(2026, 4, 2)
    assert parse_date("") is None


def test_multi_region_servicer(spark):
    df = frame(spark, [row(1, "S1", "One", D1, "NORTH", 10, 0.01, 1e6, "GREEN"),
                       row(2, "S1", "One", D1, "SOUTH", 20, 0.03, 2e6, "RED"),
                       row(3, "S2", "Two", D1, "EAST", 5, 0.02, 1e6, "GREEN")])
    k = R.kpi_summary(df).collect()[0]
    assert k["servicer_count"] == 2            # distinct servicers
    assert k["status_green"] + k["status_red"] == 3  # rows, not servicers
    assert k["avg_delinquency_rate"] == 2.0    # unweighted mean of rows
    trend = R.delinquency_trend(df).where("servicer_number = 'S1'").collect()
    assert len(trend) == 2                      # two points on one date
    bal = {r["servicer_number"]: r["balance_musd"] for r in R.portfolio_balance(df).collect()}
    assert bal == {"S1": 3.0, "S2": 1.0}


def test_renamed_servicer(spark):
    df = frame(spark, [row(1, "S1", "Old Name", D1), row(2, "S1", "New Name", D2)])
    pairs = R.servicer_list(df).collect()
    assert [r["servicer_name"] for r in pairs] == ["New Name", "Old Name"]
    assert R.servicer_count(df).collect()[0]["count"] == 2
    trend = R.delinquency_trend(df).collect()
    assert {r["series_name"] for r in trend} == {"S1 — Old Name"}  # first point's name


def test_unknown_status(spark):
    df = frame(spark, [row(1, "S1", status="BLUE"), row(2, "S2", status="GREEN")])
    st = {r["metric_status"]: r["color"] for r in R.status_distribution(df).collect()}
    assert st == {"BLUE": "#94a3b8", "GREEN": "#10b981"}
    k = R.kpi_summary(df, with_status_map=True).collect()[0]
    assert k["status_counts"] == {"BLUE": 1, "GREEN": 1, "YELLOW": 0, "RED": 0}


def test_palette_cycles_and_cuts(spark):
    rows = [row(i, f"S{i:02d}", f"N{i:02d}", D1, "NORTH", 10, 0.01, (20 - i) * 1e6)
            for i in range(10)]
    df = frame(spark, rows)
    pal = {r["servicer_number"]: (r["series_ordinal"], r["color"])
           for r in R.series_palette(df).collect()}
    assert pal["S08"] == (8, PALETTE[0]) and pal["S09"] == (9, PALETTE[1])
    bars = R.portfolio_balance(df).orderBy("bar_ordinal").collect()
    assert [r["servicer_number"] for r in bars][:2] == ["S09", "S08"]  # ascending balance
    assert [r["color"] for r in bars][8:] == [None, None]
    assert [r["color"] for r in bars][:8] == PALETTE


def test_palette_follows_filtered_set(spark):
    df = frame(spark, [row(1, "S1", "Alpha"), row(2, "S2", "Beta"), row(3, "S3", "Alpine")])
    pal = {r["servicer_number"]: r["series_ordinal"]
           for r in R.series_palette(df, ReportFilter(servicer_name="alp")).collect()}
    assert pal == {"S1": 0, "S3": 1}


def test_late_drop_snapshot(spark):
    df = frame(spark, [row(1, "S1", "A", D1), row(2, "S1", "A", D2),
                       row(3, "S2", "B", D1)])
    snap = R.snapshot(df, None).collect()
    assert [r["unique_id"] for r in snap] == [2]       # S2 absent on the last date
    moved = R.snapshot(df, ReportFilter(end_date="2025-02-27")).collect()
    assert sorted(r["unique_id"] for r in moved) == [1, 3]  # date moves with the filter


def test_null_rules(spark):
    df = frame(spark, [
        row(1, "S1", None, D1, "NORTH", 10, 0.02, 1e6, "GREEN"),
        row(2, "S2", "Two", D1, None, 10, 0.02, 1e6, None),
        row(3, "S3", "Three", D1, "EAST", None, None, None, "RED"),
        row(4, "S4", "Four", None, "WEST", 10, 0.04, 1e6, "GREEN"),
    ])
    # null name never matches the name filter
    assert apply_filters(df, ReportFilter(servicer_name="o")).count() == 2
    # null date: dropped by a lower bound, ignored by max
    assert apply_filters(df, ReportFilter(start_date="2000-01-01")).count() == 3
    assert R.kpi_summary(df).collect()[0]["as_of_date"] == "2025-02-27"
    # null group keys vanish from grouped reports
    regions = {(r["region"], r["servicer_number"]) for r in R.loan_by_region(df).collect()}
    assert regions == {("EAST", "S3"), ("WEST", "S4")}
    assert {r["metric_status"] for r in R.status_distribution(df).collect()} == {"GREEN", "RED"}
    # all-null sums are zero, missing rate is a NULL point
    s3 = [r for r in R.loan_by_region(df).collect() if r["servicer_number"] == "S3"][0]
    assert s3["loan_count"] == 0
    pts = {r["servicer_number"]: r["y"] for r in R.delinquency_trend(df).collect()}
    assert pts["S3"] is None
    bal = {r["servicer_number"]: r["balance_musd"] for r in R.portfolio_balance(df).collect()}
    assert bal["S3"] == 0.0 and "S1" not in bal
    # missing name: label is the number alone
    assert {r["series_name"] for r in R.delinquency_trend(df).collect()
            if r["servicer_number"] == "S1"} == {"S1"}


@pytest.mark.parametrize("value, n, expected", [
    (122.05, 1, 122.0), (2.675, 2, 2.67), (0.125, 2, 0.12), (3.575, 2, 3.58),
    (0.5, 0, 0.0), (1.5, 0, 2.0), (2.5, 0, 2.0), (45.4545, 3, 45.455), (-0.04, 1, -0.0),
])
def test_python_rounding_rule(spark, value, n, expected):
    got = spark.range(1).select(py_round(F.lit(value), n).alias("v")).collect()[0]["v"]
    assert got == round(value, n) == expected


def test_exact_mean(spark):
    # 0.1 + 0.2 + 0.3 + 0.4 + 0.475 (a naive float sum drifts) -> mean 0.295 -> 29.5 %
    rows = [row(i, f"S{i}", "N", D3, rate=r) for i, r in enumerate([0.1, 0.2, 0.3, 0.4, 0.475])]
    k = R.kpi_summary(frame(spark, rows)).collect()[0]
    assert k["avg_delinquency_rate"] == 29.5


def test_hot_series_is_split(spark):
    # one servicer holding most rows: its trace is folded by calendar year
    from datetime import timedelta
    rows = [row(i, "HOT", "Hot", D1 + timedelta(days=i), rate=(i % 100) / 1000)
            for i in range(2500)]
    rows += [row(10_000 + i, f"C{i}", "Cold", D1) for i in range(5)] + [row(20_000, "HOT", "Hot", None)]
    parts = R.trend_series(frame(spark, rows)).where("servicer_number = 'HOT'")
    got = sorted((r["part"], r["first_point"], len(r["x"]), r["x"][0]) for r in parts.collect())
    years = sorted({(D1 + timedelta(days=i)).year for i in range(2500)})
    sizes = [sum((D1 + timedelta(days=i)).year == y for i in range(2500)) for y in years]
    assert [g[2] for g in got] == [*sizes, 1] and got[0][2] <= 366
    assert [g[1] for g in got] == [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    assert got[1][3] == f"{D1.year + 1}-01-01" and got[-1][3] is None


def test_snapshot_holds_the_latest_rows(sample):
    for flt in (None, ReportFilter(end_date="2025-02-28"), ReportFilter(servicer_name="juniper"),
                ReportFilter(start_date="2025-03-02")):
        rows = apply_filters(sample, flt).collect()
        latest = max((r["business_date"] for r in rows), default=None)
        expected = sorted(r["unique_id"] for r in rows if r["business_date"] == latest)
        assert sorted(r["unique_id"] for r in R.snapshot(sample, flt).collect()) == expected
