"""String forms of values: labels, dates, titles and the display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import LABEL_SEPARATOR, TITLE_SUFFIX


def iso_date(d: Column) -> Column:
    """Date as ``YYYY-MM-DD`` (NULL stays NULL)."""
    return F.date_format(d, "yyyy-MM-dd")


def series_label(number: Column, name: Column) -> Column:
    """``<number> — <name>``; a missing name leaves the number alone."""
    return F.concat_ws(LABEL_SEPARATOR, number, name)


def one_decimal_text(v: Column) -> Column:
    """A value already rounded to one decimal, written as Python's ``str`` would."""
    return F.call_function("format_number", v, F.lit("0.0"))


def millions_text(v: Column) -> Column:
    """``$<v>M`` bar text of a USD-millions value."""
    return F.concat(F.lit("$"), one_decimal_text(v), F.lit("M"))


def as_of_title(prefix: str, as_of: Column) -> Column:
    """Chart title embedding the snapshot date; NULL when there is no snapshot."""
    return F.concat(F.lit(prefix), iso_date(as_of), F.lit(TITLE_SUFFIX))


# Display forms of the KPI cards: grouped integer, 1-2 decimals with '%',
# and whole USD millions with '$' and 'M'.  Half-up on the decimal text, as
# the client's number formatting does.

def grouped_integer(n: Column) -> Column:
    return F.format_number(n, 0)


def percent_text(p: Column) -> Column:
    return F.concat(F.call_function("format_number", p, F.lit("#,##0.0#")), F.lit("%"))


def whole_millions_text(m: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.round(m, 0), 0), F.lit("M"))
