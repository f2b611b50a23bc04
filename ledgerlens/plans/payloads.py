"""Response-shaped results for a charting client.

The same answers as the reports, shaped as the client reads them.  The probe
and the KPI are one record each.  The option list and the charts are datasets:
a chart is one row per trace with ``chartType``, ``title`` and the trace as
JSON, nested as the client draws it (``line.color``, ``marker.color``,
``marker.colors``; constant styling is left to the client).  A trend series
has one trace per calendar year, the balance bars one per ``PART_BARS`` bars, in
order of ``part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.filters import ReportFilter
from ledgerlens.plans import reports as R
from ledgerlens.schema import REGION_TITLE, STATUS_DOMAIN, TREND_TITLE


def health(src: R.Source) -> dict:
    return {"status": "ok", "rows": R.row_count(src).first()["rows"]}


def servicers(src: R.Source) -> DataFrame:
    """The option list in order; its size is ``reports.servicer_count``."""
    return R.servicer_list(src)


def kpi(src: R.Source, flt: ReportFilter | None = None) -> dict:
    row = R.kpi_summary(src, flt, with_status_map=True).first().asDict()
    counts = {s: 0 for s in STATUS_DOMAIN} | dict(row.pop("status_counts") or {})
    for s in STATUS_DOMAIN:
        row.pop(f"status_{s.lower()}")
    row["status_counts"] = counts
    return row


def _payload(traces: DataFrame, chart_type: str, title: Column, order: list, *trace: Column) -> DataFrame:
    return traces.select(F.lit(chart_type).alias("chartType"), title.alias("title"), *order,
                         F.to_json(F.struct(*trace)).alias("trace"))


#: Bars that a part of the balance trace holds.
PART_BARS = 10_000


def _folded(rows: DataFrame, order: str, part: Column, *columns: str) -> DataFrame:
    """Rows as records of parallel arrays, one per ``part``; none if there are no rows."""
    parts = rows.groupBy(part.cast("long").alias("part")).agg(
        F.max("title").alias("title"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), *columns))).alias("all"))
    return parts.select("title", "part", *[F.col("all").getField(c).alias(c) for c in columns])


def chart_payload(src: R.Source, name: str, flt: ReportFilter | None = None, part_bars: int = PART_BARS) -> DataFrame:
    """Traces of a chart by name; an unknown name raises ``KeyError``.

    Balance bars come in parts of ``part_bars`` by their place; the arrays of the
    parts, one after the other, are the whole trace.
    """
    R.chart(name)  # validates the name
    kind = lambda k: F.lit(k).alias("type")
    if name == "delinquency-trend":
        return _payload(
            R.trend_series(src, flt), "line", F.lit(TREND_TITLE), ["series_ordinal", "part"],
            kind("scatter"), F.lit("lines+markers").alias("mode"), F.col("series_name").alias("name"), F.col("x"),
            F.col("y"), F.struct("color").alias("line"))
    if name == "loan-by-region":
        return _payload(
            R.region_series(src, flt), "bar", F.lit(REGION_TITLE), ["series_ordinal", "part"],
            kind("bar"), F.col("series_name").alias("name"), F.col("x"), F.col("y"), F.struct("color").alias("marker"))
    if name == "portfolio-balance":
        part = F.floor(F.col("bar_ordinal") / F.lit(part_bars))
        bars = _folded(R.portfolio_balance(src, flt), "bar_ordinal", part, "balance_musd", "label", "text", "color")
        colours = F.filter("color", lambda c: c.isNotNull())
        return _payload(bars, "bar", F.col("title"), ["part"], kind("bar"), F.lit("h").alias("orientation"),
                        F.col("balance_musd").alias("x"), F.col("label").alias("y"),
                        F.struct(colours.alias("color")).alias("marker"), F.col("text"))
    slices = _folded(R.status_distribution(src, flt), "metric_status", F.lit(0), "metric_status", "count", "color")
    return _payload(slices, "pie", F.col("title"), ["part"], kind("pie"), F.col("metric_status").alias("labels"),
                    F.col("count").alias("values"), F.struct(F.col("color").alias("colors")).alias("marker"))


__all__ = ["chart_payload", "health", "kpi", "servicers"]
