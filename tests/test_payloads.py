"""Response-shaped payloads on the sample table."""

from __future__ import annotations

import json

import pytest

from ledgerlens import ReportFilter
from ledgerlens.plans import payloads as P


def traces(df, *order):
    return [(r["chartType"], r["title"], json.loads(r["trace"])) for r in df.orderBy(*order).collect()]


def test_health_and_servicers(sample):
    assert P.health(sample) == {"status": "ok", "rows": 20}
    options = P.servicers(sample).collect()
    assert len(options) == 7
    assert options[0].asDict() == {"servicer_number": "Q-11", "servicer_name": "Juniper Ledger Works"}


def test_kpi_record(sample):
    k = P.kpi(sample)
    assert k == {"total_loans": 6687, "avg_delinquency_rate": 3.58, "total_balance_usd": 952.9,
                 "servicer_count": 6, "as_of_date": "2025-03-01",
                 "status_counts": {"GREEN": 2, "YELLOW": 2, "RED": 2}}
    empty = P.kpi(sample, ReportFilter(start_date="2025-03-02"))
    assert empty["status_counts"] == {"GREEN": 0, "YELLOW": 0, "RED": 0}
    assert empty["as_of_date"] is None and empty["total_loans"] == 0


def test_chart_payloads(sample):
    trend = traces(P.chart_payload(sample, "delinquency-trend"), "series_ordinal", "part")
    assert len(trend) == 7
    kind, title, trace = trend[1]
    assert (kind, title) == ("line", "Delinquency Rate Trend (%)")
    assert trace == {"type": "scatter", "mode": "lines+markers", "name": "Q-12 — Kestrel Payment House",
                     "x": ["2025-02-27", "2025-02-28", "2025-03-01"], "y": [4.1, 4.25, 4.4],
                     "line": {"color": "#818cf8"}}
    region = traces(P.chart_payload(sample, "loan-by-region"), "series_ordinal", "part")
    assert region[0][2] == {"type": "bar", "name": "Q-11 — Juniper Ledger Works", "x": ["UPLAND"],
                            "y": [1241], "marker": {"color": "#38bdf8"}}
    (kind, title, bar), = traces(P.chart_payload(sample, "portfolio-balance"), "part")
    assert (kind, title) == ("bar", "Portfolio Balance — USD Millions (as of 2025-03-01)")
    assert bar["orientation"] == "h" and bar["x"][:2] == [12.1, 64.3] and bar["text"][1] == "$64.3M"
    assert bar["y"][0] == "Q-14 — Marlin Ledger Trust" and len(bar["marker"]["color"]) == 6
    (kind, title, pie), = traces(P.chart_payload(sample, "status-distribution"), "part")
    assert (kind, pie["labels"], pie["values"]) == ("pie", ["GREEN", "RED", "YELLOW"], [2, 2, 2])
    assert pie["marker"]["colors"] == ["#10b981", "#ef4444", "#f59e0b"]
    assert P.chart_payload(sample, "portfolio-balance", ReportFilter(servicer_number="none")).collect() == []
    with pytest.raises(KeyError):
        P.chart_payload(sample, "donut")
