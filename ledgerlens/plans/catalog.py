"""Registered queries: name -> (Spark plan over the driver's tables, SQL twin).

Every query reads the whole star schema through the adapter; parameters are
the report filters a user would pass, fixed here so the check is repeatable.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.filters import ReportFilter
from ledgerlens.plans import oracle as O
from ledgerlens.plans import reports as R
from ledgerlens.plans.dashboard import dashboard_long
from ledgerlens.schema import METRICS_COLUMNS
from ledgerlens.session import shared_root
from ledgerlens.sources.files import read_metrics_csv, write_metrics_csv
from ledgerlens.sources.star import StarSource, materialized_star, messy_metrics

# Last full month of the driver's data (the final month holds a few days only).
FULL_MONTH_END = "2001-10-31"

F_NONE = None
F_NUMBER = ReportFilter(servicer_number="SVC-00007")
F_NAME = ReportFilter(servicer_name="  SUPPLIER#00000001 ")
F_NAME_REGEX = ReportFilter(servicer_name="Supplier#0000000[13]5", name_regex=True)
F_START = ReportFilter(start_date="2001-06-15")
F_END = ReportFilter(end_date="1995-03-31")
F_ALL = ReportFilter(servicer_number="SVC-00012", servicer_name="supplier",
                     start_date="1996-01-01", end_date="1997-12-31")
F_FULL = ReportFilter(end_date=FULL_MONTH_END)
F_EMPTY = ReportFilter(start_date="2030-01-01")


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def source(spark: SparkSession, sf_dir: str) -> R.Source:
    """Metrics source of the driver's tables.

    By default the adapter's table is materialized once per session and input
    signature (load once, serve every report); ``LEDGERLENS_SOURCE=star`` runs
    every report straight from the star schema with raw-column pushdown.
    """
    if os.environ.get("LEDGERLENS_SOURCE", "materialized") == "star":
        return StarSource(spark, sf_dir)
    return materialized_star(spark, sf_dir)


def _on_metrics(report: Callable[[R.Source, ReportFilter | None], DataFrame],
                flt: ReportFilter | None) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(source(spark, sf_dir), flt)
    return build


def _whole(report: Callable[[R.Source], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(source(spark, sf_dir))
    return build


def _flat_series(nested: DataFrame, y_fmt: Callable) -> DataFrame:
    """Nested arrays as joined strings, for a flat comparison."""
    return nested.select(
        "series_ordinal", "series_name", "servicer_number", "color", "part", "first_point",
        F.array_join(F.col("x"), ",", "").alias("x_values"),
        F.array_join(F.transform("y", y_fmt), ",", "").alias("y_values"),
        F.size("x").cast("long").alias("points"))


def _trend_series_flat(src: R.Source, flt: ReportFilter | None) -> DataFrame:
    return _flat_series(R.trend_series(src, flt),
                        lambda v: F.call_function("format_number", v, F.lit("0.000")))


def _region_series_flat(src: R.Source, flt: ReportFilter | None) -> DataFrame:
    nested = R.region_series(src, flt)
    return _flat_series(nested, lambda v: v.cast("string"))


def _kpi_status_map(src: R.Source, flt: ReportFilter | None) -> DataFrame:
    k = R.kpi_summary(src, flt, with_status_map=True)
    return k.withColumn("status_counts_json", F.to_json("status_counts")).drop("status_counts")


def _kpi_display(src: R.Source, flt: ReportFilter | None) -> DataFrame:
    return R.kpi_display(R.kpi_summary(src, flt))


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy_metrics(R.filtered(source(spark, sf_dir)))


def _metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy table through a CSV copy with shuffled columns and ``NA`` for missing values."""
    path = f"{shared_root(spark)}/ledgerlens-tables/csv-copy-{uuid.uuid4().hex}"
    write_metrics_csv(_messy(spark, sf_dir), path, columns=[*METRICS_COLUMNS[5:], *METRICS_COLUMNS[:5]][::-1],
                      null_token="NA")
    return read_metrics_csv(spark, path)


def _on_messy(report: Callable[[R.Source], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(_messy(spark, sf_dir))
    return build


QUERIES: dict[str, Query] = {
    # S1 S2 X4: the metrics table itself (Parquet table; CSV copy with declared schema)
    "metrics_scan": Query(_on_metrics(R.filtered, F_NONE), O.metrics_rows(F_NONE)),
    "metrics_csv": Query(_metrics_csv, O.messy(O.metrics_rows(F_NONE))),
    # S6 A1, S5 A2
    "row_count": Query(_whole(R.row_count), O.row_count()),
    "load_profile": Query(_whole(R.load_profile), O.load_profile()),
    # R-2: P1 A13 O1, A14
    "servicer_list": Query(_whole(R.servicer_list), O.servicer_list()),
    "servicer_count": Query(_whole(R.servicer_count), O.servicer_count()),
    # F1-F5
    "filter_number": Query(_on_metrics(R.filtered, F_NUMBER), O.metrics_rows(F_NUMBER)),
    "filter_name": Query(_on_metrics(R.filtered, F_NAME), O.metrics_rows(F_NAME)),
    "filter_name_regex": Query(_on_metrics(R.filtered, F_NAME_REGEX),
                               O.metrics_rows(F_NAME_REGEX)),
    "filter_start": Query(_on_metrics(R.filtered, F_START), O.metrics_rows(F_START)),
    "filter_end": Query(_on_metrics(R.filtered, F_END), O.metrics_rows(F_END)),
    "filter_all": Query(_on_metrics(R.filtered, F_ALL), O.metrics_rows(F_ALL)),
    # F6 A3
    "latest_snapshot": Query(_on_metrics(R.snapshot, F_NONE), O.snapshot_rows(F_NONE)),
    # R-3: A4-A7 A10 F8 P5 P6 P9
    "kpi_summary": Query(_on_metrics(R.kpi_summary, F_NONE), O.kpi_summary(F_NONE)),
    "kpi_filtered": Query(_on_metrics(R.kpi_summary, F_FULL), O.kpi_summary(F_FULL)),
    "kpi_empty": Query(_on_metrics(R.kpi_summary, F_EMPTY), O.kpi_summary(F_EMPTY)),
    "kpi_display": Query(_on_metrics(_kpi_display, F_NONE), O.kpi_display(F_NONE)),
    "kpi_status_map": Query(_on_metrics(_kpi_status_map, F_NONE), O.kpi_status_map(F_NONE)),
    # A9 A10
    "status_counts": Query(_on_metrics(R.kpi_status_counts, F_NONE), O.status_counts(F_NONE)),
    # R-4, A15 A16 S8, W1 P12 X8
    "delinquency_trend": Query(_on_metrics(R.delinquency_trend, F_NONE),
                               O.delinquency_trend(F_NONE)),
    "trend_series": Query(_on_metrics(_trend_series_flat, F_NONE), O.trend_series(F_NONE)),
    "series_palette": Query(_on_metrics(R.series_palette, F_NONE),
                            O.series_palette(F_NONE)),
    # R-5 A11 O3, A15
    "loan_by_region": Query(_on_metrics(R.loan_by_region, F_NONE), O.loan_by_region(F_NONE)),
    "region_series": Query(_on_metrics(_region_series_flat, F_NONE), O.region_series(F_NONE)),
    # R-6 P8 P10 P13 W2
    "portfolio_balance": Query(_on_metrics(R.portfolio_balance, F_NONE),
                               O.portfolio_balance(F_NONE)),
    # R-7 A8 A17 P11 W3
    "status_distribution": Query(_on_metrics(R.status_distribution, F_NONE),
                                 O.status_distribution(F_NONE)),
    # X6
    "round_rules": Query(_whole(R.round_rules), O.round_rules()),
    # R-9
    "dashboard": Query(_on_metrics(dashboard_long, F_NONE), O.dashboard(F_NONE)),
    # A18 Q8-Q11 A9 A16: missing values, new names, an unknown status
    "messy_kpi": Query(_on_messy(lambda m: _kpi_status_map(m, None)), O.messy(O.kpi_status_map(F_NONE))),
    "messy_trend": Query(_on_messy(R.delinquency_trend), O.messy(O.delinquency_trend(F_NONE))),
    "messy_trend_series": Query(_on_messy(lambda m: _trend_series_flat(m, None)), O.messy(O.trend_series(F_NONE))),
    "messy_region": Query(_on_messy(R.loan_by_region), O.messy(O.loan_by_region(F_NONE))),
    "messy_balance": Query(_on_messy(R.portfolio_balance), O.messy(O.portfolio_balance(F_NONE))),
    "messy_status": Query(_on_messy(R.status_distribution), O.messy(O.status_distribution(F_NONE))),
    "messy_servicers": Query(_on_messy(R.servicer_list), O.messy(O.servicer_list())),
    "messy_dashboard": Query(_on_messy(dashboard_long), O.messy(O.dashboard(F_NONE))),
}
