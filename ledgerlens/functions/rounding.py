"""Rounding and exact-average rules shared by every report.

R1: the reports round like Python's ``round`` on a double: the exact binary
value, ties to even.  Spark's ``round``/``bround`` round the shortest decimal
text instead (122.05 -> 122.1 where Python gives 122.0), so the rule goes
through ``format_number`` with a pattern, which formats the binary value.

R2: a float average depends on summing order.  Rates are summed as exact
integers (``RATE_UNITS`` per 1.0) and divided once; money is summed in exact
cents and divided once.  All sums are DECIMAL so they cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed-point scale for exact rate sums (1e-9 of a fraction).
RATE_UNITS = 1e9
# Cents per dollar.
CENTS = 100


def py_round(col: Column, ndigits: int) -> Column:
    """Round a double to ``ndigits`` decimals the way Python's ``round`` does."""
    pattern = "0" if ndigits == 0 else "0." + "0" * ndigits
    return F.call_function("format_number", col, F.lit(pattern)).cast("double")


def rate_units(rate: Column) -> Column:
    """A rate (fraction) as an exact fixed-point integer, summable without drift."""
    return F.round(rate * F.lit(RATE_UNITS)).cast("decimal(20,0)")


def cents(amount: Column) -> Column:
    """A money amount as exact integer cents."""
    return F.round(amount * F.lit(CENTS)).cast("decimal(20,0)")


def mean_percent(sum_units: Column, n: Column, ndigits: int) -> Column:
    """Percent from an exact rate-unit sum and a count, one division, then R1.

    NULL when there is nothing to average.
    """
    scale = RATE_UNITS / 100.0
    value = sum_units.cast("double") / (F.lit(scale) * n)
    return F.when(n > 0, py_round(value, ndigits))


def millions(sum_cents: Column, ndigits: int) -> Column:
    """USD millions from exact cents, one division, then R1."""
    return py_round(sum_cents.cast("double") / F.lit(CENTS * 1e6), ndigits)


def percent_of(rate: Column, ndigits: int) -> Column:
    """A fraction shown as a percent with ``ndigits`` decimals (R1)."""
    return py_round(rate * F.lit(100), ndigits)
