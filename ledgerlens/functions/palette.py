"""Colour lookups: series palette (cycling or cut) and status colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.schema import DEFAULT_STATUS_COLOUR, PALETTE, STATUS_COLOURS


def _palette() -> Column:
    return F.array(*[F.lit(c) for c in PALETTE])


def cycling_colour(ordinal: Column) -> Column:
    """Palette entry for a 0-based series ordinal, wrapping around."""
    idx = (ordinal % F.lit(len(PALETTE))).cast("int") + F.lit(1)
    return F.element_at(_palette(), idx)


def cut_colour(ordinal: Column) -> Column:
    """Palette entry for the first ``len(PALETTE)`` rows, NULL after that."""
    return F.when(ordinal < F.lit(len(PALETTE)),
                  F.element_at(_palette(), ordinal.cast("int") + F.lit(1)))


def status_colour(status: Column) -> Column:
    """Colour of a status, with the default colour for any other value."""
    expr = None
    for name, colour in STATUS_COLOURS.items():
        expr = (F.when(status == F.lit(name), F.lit(colour)) if expr is None
                else expr.when(status == F.lit(name), F.lit(colour)))
    return expr.otherwise(F.lit(DEFAULT_STATUS_COLOUR))
