"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from ledgerlens.functions.palette import cut_colour, cycling_colour, status_colour
from ledgerlens.functions.rounding import (
    cents, mean_percent, millions, percent_of, py_round, rate_units)
from ledgerlens.functions.text import (
    as_of_title, grouped_integer, iso_date, millions_text, one_decimal_text,
    percent_text, series_label, whole_millions_text)

__all__ = [
    "as_of_title", "cents", "cut_colour", "cycling_colour", "grouped_integer",
    "iso_date", "mean_percent", "millions", "millions_text", "one_decimal_text",
    "percent_of", "percent_text", "py_round", "rate_units", "series_label",
    "status_colour", "whole_millions_text",
]
