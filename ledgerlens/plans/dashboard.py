"""R-9: the KPI and the four charts under one filter.

Besides the trend's points the charts need two aggregates: sums per (region,
number, name), which also hold the trend's series names, and the snapshot's
parts.  Each is computed in one scan and kept as a small table in the shared
folder; all five reports then read those tables, and only the trend reads the
filtered rows again.  No fact row is cached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.aggregates import kpi_row, snapshot_parts
from ledgerlens.operators.filters import ReportFilter
from ledgerlens.operators.series import numbered_series
from ledgerlens.plans import reports as R
from ledgerlens.plans.sinks import write_dataset, write_traces
from ledgerlens.schema import REGION_TITLE, TREND_TITLE
from ledgerlens.sources.materialized import stored_small

DASHBOARD_COLUMNS = ["report", "series", "ordinal", "x", "y", "text", "color", "title"]

KPI_FIELDS = ["total_loans", "avg_delinquency_rate", "total_balance_usd", "servicer_count",
              "status_green", "status_yellow", "status_red"]


def _shape(df: DataFrame, report: str, series, ordinal, x, y, text, color, title) -> DataFrame:
    def c(v, kind):
        return (v if v is not None else F.lit(None)).cast(kind)
    return df.select(
        F.lit(report).alias("report"), c(series, "string").alias("series"),
        c(ordinal, "long").alias("ordinal"), c(x, "string").alias("x"),
        c(y, "double").alias("y"), c(text, "string").alias("text"),
        c(color, "string").alias("color"), c(title, "string").alias("title"))


def kpi_long(kpi: DataFrame) -> DataFrame:
    """The KPI row unpivoted: one row per headline number, x = as-of date."""
    pairs = ", ".join(f"'{name}', {i}L, cast({name} as double)"
                      for i, name in enumerate(KPI_FIELDS))
    stacked = kpi.select("as_of_date", F.expr(
        f"stack({len(KPI_FIELDS)}, {pairs}) as (series, ordinal, y)"))
    return _shape(stacked, "kpi", F.col("series"), F.col("ordinal"), F.col("as_of_date"),
                  F.col("y"), None, None, None)


def shared_aggregates(src: R.Source, flt: ReportFilter | None) -> tuple[DataFrame, DataFrame]:
    """The two small tables: sums per (region, number, name), and the snapshot's parts."""
    place = F.struct(F.col("business_date").isNull().alias("no_date"), "business_date",
                     F.col("unique_id").isNull().alias("no_id"), "unique_id")
    groups = R.filtered(src, flt).where(F.col("servicer_number").isNotNull()).groupBy(
        "region", "servicer_number", "servicer_name").agg(
        F.coalesce(F.sum("loan_count"), F.lit(0)).cast("long").alias("loan_count"), F.min(place).alias("first_at"))
    return (stored_small(groups, "dashboard-groups"),
            stored_small(snapshot_parts(R.snapshot(src, flt)), "dashboard-snapshot"))


def charts(src: R.Source, flt: ReportFilter | None = None) -> dict[str, DataFrame]:
    """KPI row, trend, region bars, balance bars and status shares over the shared aggregates."""
    groups, parts = shared_aggregates(src, flt)
    names = groups.groupBy("servicer_number").agg(F.min_by("servicer_name", "first_at").alias("first_name"))
    bars = groups.where(F.col("region").isNotNull() & F.col("servicer_name").isNotNull()).drop("first_at")
    return {"kpi": kpi_row(parts), "trend": R.trend_of(R.filtered(src, flt), numbered_series(names)),
            "region": R.region_bars(bars), "balance": R.balance_of(parts), "status": R.status_of(parts)}


def dashboard_parts(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five results in the common long schema."""
    shape = {
        "kpi": lambda d: kpi_long(d),
        "trend": lambda d: _shape(d, "trend", F.col("series_name"), F.col("series_ordinal"),
                                  F.col("x"), F.col("y"), None, F.col("color"), F.lit(TREND_TITLE)),
        "region": lambda d: _shape(d, "region", F.col("series_name"), F.col("series_ordinal"),
                                   F.col("region"), F.col("loan_count"), None, F.col("color"),
                                   F.lit(REGION_TITLE)),
        "balance": lambda d: _shape(d, "balance", F.col("label"), F.col("bar_ordinal"),
                                    F.col("label"), F.col("balance_musd"), F.col("text"),
                                    F.col("color"), F.col("title")),
        "status": lambda d: _shape(d, "status", F.col("metric_status"), None,
                                   F.col("metric_status"), F.col("count"),
                                   F.concat(F.call_function("format_number", F.col("share_pct"),
                                                            F.lit("0.0")), F.lit("%")),
                                   F.col("color"), F.col("title")),
    }
    return {name: shape[name](df) for name, df in found.items()}


def dashboard_long(src: R.Source, flt: ReportFilter | None = None) -> DataFrame:
    """The five reports as one tagged long table."""
    parts = list(dashboard_parts(charts(src, flt)).values())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_dashboard(src: R.Source, flt: ReportFilter | None, out_dir: str,
                  fmt: str = "json", traces: bool = False) -> dict[str, str]:
    """Write the five datasets under ``out_dir``.

    ``traces=True`` also writes the trend and region charts as nested traces
    for a charting client.
    """
    found = charts(src, flt)
    paths = {}
    for name, part in dashboard_parts(found).items():
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        write_dataset(part, paths[name], fmt)
    if traces:
        for name, nested, chart_type, title in (
                ("trend_traces", R.nested_trend(found["trend"]), "line", TREND_TITLE),
                ("region_traces", R.nested_region(found["region"]), "bar", REGION_TITLE)):
            paths[name] = f"{out_dir.rstrip('/')}/{name}"
            write_traces(nested, paths[name], chart_type, title)
    return paths
