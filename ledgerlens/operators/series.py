"""Series (chart traces): per-series tables and long-to-nested folding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.palette import cycling_colour
from ledgerlens.functions.text import series_label
from ledgerlens.operators.ordinals import with_ordinal


def first_by(value: str, order: Sequence[Column]) -> Column:
    """Value of the row that comes first in ``order`` (NULL order keys last)."""
    keys = []
    for c in order:
        keys.extend([c.isNull(), c])
    return F.min_by(F.col(value), F.struct(*keys))


def series_table(points: DataFrame, first_name_order: Sequence[Column]) -> DataFrame:
    """One row per servicer number: label, 0-based ordinal and palette colour.

    The label uses the servicer's first name in ``first_name_order``; the
    ordinal ranks the numbers present in ``points``.
    """
    return numbered_series(points.groupBy("servicer_number").agg(
        first_by("servicer_name", first_name_order).alias("first_name")))


def numbered_series(per_series: DataFrame) -> DataFrame:
    """Label, ordinal and colour for ``per_series(servicer_number, first_name)``."""
    ranked = with_ordinal(per_series, ["servicer_number"], name="series_ordinal")
    return ranked.select(
        "servicer_number",
        series_label(F.col("servicer_number"), F.col("first_name")).alias("series_name"),
        "series_ordinal",
        cycling_colour(F.col("series_ordinal")).alias("color"),
    )


def nest_series(long_df: DataFrame, series_cols: Sequence[str], order_cols: Sequence[str],
                x: str, y: str, period: Column | None = None) -> DataFrame:
    """Fold long-form points into records with parallel arrays x, y.

    Points are ordered by ``order_cols`` (NULLs last) within each record.
    ``period`` cuts a series into one record per period (for a time axis: its
    year), whatever the size of the data, so a heavy series is spread over
    many groups.  Output: ``series_cols``, ``part`` (0-based, periods in order,
    NULL last), ``first_point`` (position of the record's first point in its
    series), ``x``, ``y``.
    """
    order = [c for k in order_cols for c in (F.col(k).isNull().alias(f"no_{k}"), F.col(k).alias(f"by_{k}"))]
    point = F.struct(*order, F.col(x).alias("x"), F.col(y).alias("y"))
    keyed = long_df.withColumn("_period", period if period is not None else F.lit(0))
    nested = keyed.groupBy(*series_cols, "_period").agg(F.array_sort(F.collect_list(point)).alias("_pts"))
    inside = Window.partitionBy(*series_cols).orderBy(F.asc_nulls_last("_period"))
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return nested.select(
        *series_cols,
        (F.row_number().over(inside) - 1).cast("long").alias("part"),
        F.coalesce(F.sum(F.size("_pts")).over(before), F.lit(0)).cast("long").alias("first_point"),
        F.transform("_pts", lambda p: p["x"]).alias("x"),
        F.transform("_pts", lambda p: p["y"]).alias("y"),
    )
