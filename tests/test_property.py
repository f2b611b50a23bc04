"""Random small tables: every report against a plain-Python model of its rules."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from datetime import date

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from ledgerlens import ReportFilter
from ledgerlens.plans import reports as R
from ledgerlens.schema import DEFAULT_STATUS_COLOUR, PALETTE, STATUS_COLOURS
from tests.fixtures import frame

DATES = [date(2026, 3, 30), date(2026, 3, 31), date(2026, 4, 1), None]
NUMBERS = ["S1", "S2", "S3", "S10", "S4", "S5", "S6", "S7", "S8", "S9", "S11", None]
NAMES = ["Iris Co", "iris two", "Bay", None]
REGIONS = ["EAST", "WEST", None]
STATUSES = ["GREEN", "YELLOW", "RED", "BLUE", None]


def _none_last(v):
    return (v is None, v if v is not None else 0)


def _label(number, name):
    return number if name is None else f"{number} — {name}"


@st.composite
def tables(draw):
    n = draw(st.integers(min_value=0, max_value=24))
    rows = []
    for i in range(n):
        rows.append((
            1000 + i,
            draw(st.sampled_from(NUMBERS)), draw(st.sampled_from(NAMES)), "t",
            draw(st.sampled_from(DATES)), draw(st.sampled_from(REGIONS)),
            draw(st.one_of(st.none(), st.integers(0, 3000))),
            draw(st.one_of(st.none(), st.integers(0, 120).map(lambda k: k / 1000))),
            draw(st.one_of(st.none(), st.integers(0, 10**9).map(lambda c: c / 100))),
            draw(st.sampled_from(STATUSES)),
        ))
    flt = draw(st.sampled_from([
        None, ReportFilter(servicer_name="iris"), ReportFilter(servicer_number="S2"),
        ReportFilter(servicer_name="^i.i", name_regex=True),
        ReportFilter(start_date="2026-03-31"), ReportFilter(end_date="2026-03-31")]))
    return rows, flt


def model_filter(rows, flt):
    out = []
    for r in rows:
        if flt is not None:
            if flt.servicer_number and r[1] != flt.servicer_number:
                continue
            if flt.servicer_name:
                if r[2] is None:
                    continue
                name = r[2].lower()
                hit = (re.search(flt.name_pattern, name) if flt.name_regex
                       else flt.name_pattern in name)
                if not hit:
                    continue
            if flt.start and (r[4] is None or r[4] < flt.start):
                continue
            if flt.end and (r[4] is None or r[4] > flt.end):
                continue
        out.append(r)
    return out


def model_snapshot(rows):
    dates = [r[4] for r in rows if r[4] is not None]
    return [r for r in rows if dates and r[4] == max(dates)]


def model_kpi(rows):
    snap = model_snapshot(rows)
    rates = [r[7] for r in snap if r[7] is not None]
    if not snap:
        avg = 0.0
    elif not rates:
        avg = None
    else:
        avg = round(sum(round(x * 1e9) for x in rates) / (1e7 * len(rates)), 2)
    cents = sum(round(r[8] * 100) for r in snap if r[8] is not None)
    dates = [r[4] for r in snap]
    return (sum(r[6] for r in snap if r[6] is not None), avg, round(cents / 1e8, 1),
            len({r[1] for r in snap if r[1] is not None}),
            sum(r[9] == "GREEN" for r in snap), sum(r[9] == "YELLOW" for r in snap),
            sum(r[9] == "RED" for r in snap),
            dates[0].isoformat() if dates else None)


def model_series(points, first_key):
    firsts = {}
    for p in sorted(points, key=first_key):
        firsts.setdefault(p[1], p[2])
    order = sorted(firsts)
    return {num: (_label(num, firsts[num]), i, PALETTE[i % 8]) for i, num in enumerate(order)}


def model_trend(rows):
    pts = [r for r in rows if r[1] is not None]
    ser = model_series(pts, lambda r: (_none_last(r[4]), r[0]))
    return sorted(((r[1], *ser[r[1]], r[4].isoformat() if r[4] else None,
                    None if r[7] is None else round(r[7] * 100, 3), r[0]) for r in pts), key=repr)


def model_region(rows):
    sums = defaultdict(int)
    for r in rows:
        if r[5] is not None and r[1] is not None and r[2] is not None:
            sums[(r[5], r[1], r[2])] += r[6] or 0
    groups = [(None, num, name, region, total) for (region, num, name), total in sums.items()]
    ser = model_series(groups, lambda g: (g[3], g[2]))
    return sorted(((num, *ser[num], name, region, total)
                   for _, num, name, region, total in groups), key=repr)


def model_balance(rows):
    cents = defaultdict(int)
    for r in model_snapshot(rows):
        if r[1] is not None and r[2] is not None:
            cents[(r[1], r[2])] += round(r[8] * 100) if r[8] is not None else 0
    bars = sorted(cents.items(), key=lambda kv: (kv[1], kv[0][0], kv[0][1]))
    out = []
    for i, ((num, name), c) in enumerate(bars):
        v = round(c / 1e8, 1)
        out.append((i, num, name, _label(num, name), v, f"${v:.1f}M",
                    PALETTE[i] if i < 8 else None))
    return out


def model_status(rows):
    counts = defaultdict(int)
    for r in model_snapshot(rows):
        if r[9] is not None:
            counts[r[9]] += 1
    total = sum(counts.values())
    return sorted(((s, n, n * 100 / total, STATUS_COLOURS.get(s, DEFAULT_STATUS_COLOUR))
                   for s, n in counts.items()), key=repr)


_EXAMPLES = int(os.environ.get("LEDGERLENS_PROPERTY_EXAMPLES", "8"))


@settings(max_examples=_EXAMPLES, deadline=None, derandomize=_EXAMPLES <= 12,
          phases=[Phase.explicit, Phase.reuse, Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(tables())
def test_reports_match_model(spark, case):
    rows, flt = case
    df = frame(spark, rows)
    kept = model_filter(rows, flt)

    k = R.kpi_summary(df, flt).collect()[0]
    assert (k["total_loans"], k["avg_delinquency_rate"], k["total_balance_usd"],
            k["servicer_count"], k["status_green"], k["status_yellow"], k["status_red"],
            k["as_of_date"]) == model_kpi(kept)

    trend = sorted(((r["servicer_number"], r["series_name"], r["series_ordinal"], r["color"],
                    r["x"], r["y"], r["unique_id"]) for r in R.delinquency_trend(df, flt).collect()),
                   key=repr)
    assert trend == model_trend(kept)

    region = sorted(((r["servicer_number"], r["series_name"], r["series_ordinal"], r["color"],
                      r["servicer_name"], r["region"], r["loan_count"])
                     for r in R.loan_by_region(df, flt).collect()), key=repr)
    assert region == model_region(kept)

    bal = [(r["bar_ordinal"], r["servicer_number"], r["servicer_name"], r["label"],
            r["balance_musd"], r["text"], r["color"])
           for r in R.portfolio_balance(df, flt).orderBy("bar_ordinal").collect()]
    assert bal == model_balance(kept)

    status = sorted(((r["metric_status"], r["count"], r["share_pct"], r["color"])
                     for r in R.status_distribution(df, flt).collect()), key=repr)
    assert status == model_status(kept)
