"""The reports: each is ``(source, ReportFilter) -> DataFrame``.

A source is a metrics DataFrame or a ``ReportFilter -> DataFrame`` callable
that can use the filter to prune its scan (see ``ledgerlens.sources.base``).
Long form (one row per point, bar or slice) is the primary result; ordering
that matters to a chart is carried as columns (ordinals, sort keys), so a
result can be written in parallel and sorted by whoever draws it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Union

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.palette import cut_colour, status_colour
from ledgerlens.functions.rounding import millions, percent_of, py_round
from ledgerlens.functions.text import (
    as_of_title, grouped_integer, iso_date, millions_text, percent_text, series_label,
    whole_millions_text)
from ledgerlens.operators.aggregates import (
    PAIRS, STATUSES, approximate_kpi_row, balance_parts, kpi_row, kpi_with_status_map, profile_of_sketches,
    servicer_sketches, snapshot_parts, status_counts, status_parts)
from ledgerlens.operators.filters import NO_FILTER, ReportFilter, apply_filters
from ledgerlens.operators.ordinals import with_ordinal
from ledgerlens.operators.series import nest_series, series_table
from ledgerlens.operators.snapshot import latest_date, latest_date_value
from ledgerlens.schema import BALANCE_TITLE_PREFIX, METRICS_COLUMNS, STATUS_TITLE_PREFIX
from ledgerlens.sources.base import MetricsSource, as_source
from ledgerlens.sources.files import latest_partition

Source = Union[DataFrame, MetricsSource]
Report = Callable[[Source, "ReportFilter | None"], DataFrame]


# --- R-1, R-2: table-level questions (no filters) ---------------------------

def _whole(src: Source) -> DataFrame:
    return as_source(src)(None)


def row_count(src: Source) -> DataFrame:
    return _whole(src).agg(F.count(F.lit(1)).alias("rows"))


def load_profile(src: Source, approximate: bool = False) -> DataFrame:
    """Rows and distinct servicers; ``approximate`` estimates the latter from one mergeable sketch per date."""
    if approximate:
        return profile_of_sketches(servicer_sketches(_whole(src)))
    return _whole(src).agg(F.count(F.lit(1)).alias("rows"),
                           F.count_distinct("servicer_number").alias("servicers"))


def servicer_list(src: Source) -> DataFrame:
    """Distinct (number, name) pairs, sorted by number then name (NULLs last)."""
    pairs = _whole(src).select("servicer_number", "servicer_name").distinct()
    return pairs.orderBy(F.asc_nulls_last("servicer_number"), F.asc_nulls_last("servicer_name"))


def servicer_count(src: Source) -> DataFrame:
    return (_whole(src).select("servicer_number", "servicer_name").distinct()
            .agg(F.count(F.lit(1)).alias("count")))


# --- Filters and snapshot ----------------------------------------------------

def filtered(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """The source with the report filters applied (the filter also prunes the scan)."""
    return apply_filters(as_source(src)(flt), flt).select(*METRICS_COLUMNS)


def snapshot(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """Rows at the latest date of the filtered set (the date moves with the filters).

    A table partitioned by date gives the date by its partitions if only dates
    filter, and else joins the rows to their greatest date (one row), with
    which Spark prunes partitions when the query runs; neither needs a job before the plan.
    Any other source is asked for the date first (one small job).  Then the
    source is read again pinned to that one date, so only its data is scanned.
    """
    source = as_source(src)
    if getattr(source, "by_date", False):
        if flt is not None and (flt.servicer_number or flt.servicer_name):
            rows = filtered(source, flt)
            return rows.join(F.broadcast(latest_date(rows)), "business_date", "left_semi").select(*METRICS_COLUMNS)
        latest = latest_partition(source(None), flt)
    else:
        latest = latest_date_value(apply_filters(source(flt), flt))
    if latest is None:
        return apply_filters(source(flt), flt).where(F.lit(False)).select(*METRICS_COLUMNS)
    pinned = replace(flt or NO_FILTER, start_date=latest, end_date=latest)
    return filtered(source, pinned)


# --- R-3: KPI ------------------------------------------------------------------

def kpi_summary(src: Source, flt: ReportFilter | None = None,
                with_status_map: bool = False, approximate: bool = False) -> DataFrame:
    """One row of headline numbers over the latest snapshot; zeros when empty.

    ``approximate`` (without the map) estimates the servicer count by a sketch.
    """
    if approximate:
        if with_status_map:
            raise ValueError("the status map comes with exact counts only")
        return approximate_kpi_row(snapshot(src, flt))
    parts = snapshot_parts(snapshot(src, flt))
    return kpi_with_status_map(parts) if with_status_map else kpi_row(parts)


def kpi_status_counts(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """Snapshot row count per status, the fixed three always present."""
    return status_counts(status_parts(snapshot(src, flt)))


def kpi_display(kpi: DataFrame) -> DataFrame:
    """Card texts of a KPI row: grouped loans, percent with 1-2 decimals, $<n>M."""
    return kpi.select(
        grouped_integer(F.col("total_loans")).alias("total_loans_text"),
        percent_text(F.col("avg_delinquency_rate")).alias("avg_delinquency_text"),
        whole_millions_text(F.col("total_balance_usd")).alias("total_balance_text"),
        F.col("servicer_count"),
        F.col("as_of_date"),
    )


# --- R-4: delinquency trend ---------------------------------------------------

def delinquency_trend(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """One point per filtered row, one series per servicer number.

    Points are ordered by (business_date, unique_id); the series label takes
    the name of the first point; colour cycles through the palette by series
    ordinal.
    """
    return trend_of(filtered(src, flt))


def trend_of(rows: DataFrame, series: DataFrame | None = None) -> DataFrame:
    points = rows.where(F.col("servicer_number").isNotNull())
    if series is None:
        series = series_table(points, [F.col("business_date"), F.col("unique_id")])
    # Every point has its series; as an outer join only the series side can be broadcast.
    return points.join(series, "servicer_number", "left").select(
        "series_ordinal", "series_name", "servicer_number", "color",
        "business_date",
        iso_date(F.col("business_date")).alias("x"),
        percent_of(F.col("delinquency_rate"), 3).alias("y"),
        "unique_id",
    )


SERIES_COLUMNS = ["series_ordinal", "series_name", "servicer_number", "color"]


def nested_trend(trend: DataFrame) -> DataFrame:
    """Trend points folded to one record per series and calendar year."""
    return nest_series(trend, SERIES_COLUMNS, ["business_date", "unique_id"], "x", "y",
                       F.year("business_date"))


def nested_region(region: DataFrame) -> DataFrame:
    """Region bars folded to one record per series."""
    return nest_series(region, SERIES_COLUMNS, ["region", "servicer_name"], "region", "loan_count")


def trend_series(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """Delinquency trend with x/y arrays, a record per series and calendar year."""
    return nested_trend(delinquency_trend(src, flt))


def series_palette(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """Series ordinal and colour of each servicer number in the filtered set."""
    points = filtered(src, flt).where(F.col("servicer_number").isNotNull())
    return series_table(points, [F.col("business_date"), F.col("unique_id")]).select(
        "servicer_number", "series_ordinal", "color")


# --- R-5: loans by region -----------------------------------------------------

def loan_by_region(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """Loan counts summed over all dates per (region, number, name).

    Rows with a missing region, number or name are left out; one series per
    number, points ordered by region then name.
    """
    return region_of(filtered(src, flt))


def region_of(rows: DataFrame) -> DataFrame:
    rows = rows.where(
        F.col("region").isNotNull() & F.col("servicer_number").isNotNull()
        & F.col("servicer_name").isNotNull())
    return region_bars(rows.groupBy("region", "servicer_number", "servicer_name").agg(
        F.coalesce(F.sum("loan_count"), F.lit(0)).cast("long").alias("loan_count")))


def region_bars(grouped: DataFrame) -> DataFrame:
    """Bars with series label, ordinal and colour from the sums per (region, number, name)."""
    series = series_table(grouped, [F.col("region"), F.col("servicer_name")])
    return grouped.join(series, "servicer_number", "left").select(
        "series_ordinal", "series_name", "servicer_number", "servicer_name", "color",
        "region", "loan_count")


def region_series(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """Loans by region with x (region) / y arrays, a record per series."""
    return nested_region(loan_by_region(src, flt))


# --- R-6: portfolio balance ---------------------------------------------------

def portfolio_balance(src: Source, flt: ReportFilter | None = None, first: int | None = None) -> DataFrame:
    """Balance per (number, name) on the latest snapshot, ascending.

    Value in USD millions (1 dp); palette colours for the first eight bars only.
    ``first`` gives that many bars (at most ``MOST_FIRST``) and puts no others in order.
    """
    return balance_of(balance_parts(snapshot(src, flt)), first)


#: Bars that a caller may ask for as the first ones; they are numbered in one task.
MOST_FIRST = 10_000


def _first_bars(bars: DataFrame, order: list[str], first: int) -> DataFrame:
    """The first bars with their ordinals: every task keeps its own first ones, which are merged on the driver."""
    if not 0 < first <= MOST_FIRST:
        raise ValueError(f"first must be 1 to {MOST_FIRST}")
    keys = [F.asc_nulls_last(c) for c in order]
    return bars.orderBy(*keys).limit(first).withColumn(
        "bar_ordinal", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))


def balance_of(parts: DataFrame, first: int | None = None) -> DataFrame:
    bars = parts.where((F.col("kind") == PAIRS) & F.col("servicer_number").isNotNull()
                       & F.col("servicer_name").isNotNull()).select(
        "servicer_number", "servicer_name",
        F.coalesce("cents", F.lit(0)).cast("decimal(38,0)").alias("balance_cents"), "as_of")
    order = ["balance_cents", "servicer_number", "servicer_name"]
    ranked = _first_bars(bars, order, first) if first else with_ordinal(bars, order, name="bar_ordinal")
    value = millions(F.col("balance_cents"), 1)
    return ranked.select(
        "bar_ordinal", "servicer_number", "servicer_name",
        series_label(F.col("servicer_number"), F.col("servicer_name")).alias("label"),
        value.alias("balance_musd"),
        millions_text(value).alias("text"),
        cut_colour(F.col("bar_ordinal")).alias("color"),
        as_of_title(BALANCE_TITLE_PREFIX, F.col("as_of")).alias("title"),
    )


# --- R-7: status distribution ------------------------------------------------

def status_distribution(src: Source, flt: ReportFilter | None = None) -> DataFrame:
    """Snapshot rows per status (no zero-fill), share of total, colour, title."""
    return status_of(status_parts(snapshot(src, flt)))


def status_of(parts: DataFrame) -> DataFrame:
    counts = parts.where((F.col("kind") == STATUSES) & F.col("metric_status").isNotNull()).select(
        "metric_status", F.col("rows").alias("count"), "as_of")
    # One row per status value: the window runs on the aggregated rows only.
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(
        "metric_status", "count",
        (F.col("count").cast("double") * F.lit(100) / total).alias("share_pct"),
        status_colour(F.col("metric_status")).alias("color"),
        as_of_title(STATUS_TITLE_PREFIX, F.col("as_of")).alias("title"),
    )


# --- Rounding rule demonstration over the whole table ------------------------

def round_rules(src: Source) -> DataFrame:
    """Each row's rate and balance rounded by R1 at the precisions reports use."""
    return _whole(src).select(
        "unique_id",
        percent_of(F.col("delinquency_rate"), 1).alias("rate_pct_1"),
        percent_of(F.col("delinquency_rate"), 2).alias("rate_pct_2"),
        percent_of(F.col("delinquency_rate"), 3).alias("rate_pct_3"),
        py_round(F.col("total_balance_usd") / F.lit(1e6), 1).alias("balance_m_1"),
        py_round(F.col("total_balance_usd") / F.lit(1e6), 2).alias("balance_m_2"),
    )


# --- R-8: dispatch by chart name ---------------------------------------------

CHARTS: dict[str, Report] = {
    "delinquency-trend": delinquency_trend,
    "loan-by-region": loan_by_region,
    "portfolio-balance": portfolio_balance,
    "status-distribution": status_distribution,
}


def chart(name: str) -> Report:
    """Report function of a chart name; an unknown name raises ``KeyError``."""
    try:
        return CHARTS[name]
    except KeyError:
        raise KeyError(f"unknown chart {name!r}; expected one of {sorted(CHARTS)}") from None
