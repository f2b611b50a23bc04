"""Metrics reporting on Spark: filters, snapshot KPIs and chart series as DataFrames."""

from ledgerlens.operators.filters import NO_FILTER, ReportFilter, apply_filters, parse_date

__all__ = ["NO_FILTER", "ReportFilter", "apply_filters", "parse_date"]
