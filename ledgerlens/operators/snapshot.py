"""Latest snapshot: the rows at the single greatest date of a (filtered) frame."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_date(df: DataFrame) -> DataFrame:
    """One-row frame holding the greatest non-null ``business_date`` (NULL if none)."""
    return df.agg(F.max("business_date").alias("business_date"))


def latest_date_value(df: DataFrame) -> date | None:
    """The latest date as a plan-time value (one small aggregate job).

    Binding the snapshot date as a literal lets a date-partitioned table prune
    to a single partition and lets a derived source bound its raw scan; a
    semi-join on the greatest date could do neither.
    """
    return latest_date(df).first()["business_date"]
