"""Global 0-based ordinals over a total order, without a single-task window.

An unpartitioned ``row_number()`` window moves every row to one task.  Here the
rows are range-partitioned by the order and sorted inside their partition, so
the place of a row is its place in the partition plus the rows of the
partitions before it.  Spark sizes the ranges from the data; there is no
constant number of groups.  The placed rows are written once to the shared
folder, so they are computed once and a lost executor never replays them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.materialized import stored_small

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def with_ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal", nulls_first: bool = False,
                 spread: Sequence[Column] = ()) -> DataFrame:
    """Add ``name``: the 0-based position of each row by the ``order`` columns.

    Keys sort ascending, NULLs last unless ``nulls_first``; ties go by the
    remaining columns.  Rows equal in all of them are interchangeable: ``spread``
    columns (such as a row number of a stored table) let many such rows fall
    into several ranges.
    """
    up = F.asc_nulls_first if nulls_first else F.asc_nulls_last
    keys = [up(c) for c in [*order, *(c for c in df.columns if c not in order)]]
    placed = df.repartitionByRange(*keys, *spread).sortWithinPartitions(*keys)
    rows = stored_small(placed.withColumn("_ord_at", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright("_ord_at", _PLACE_BITS)
    counts = rows.groupBy(part.alias("_ord_part")).agg(F.count(F.lit(1)).alias("_ord_n"))
    before = Window.orderBy("_ord_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition: safe to add up in one task and to broadcast
    offsets = counts.select("_ord_part", F.coalesce(F.sum("_ord_n").over(before), F.lit(0)).alias("_ord_off"))
    inside = F.col("_ord_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return rows.withColumn("_ord_part", part).join(F.broadcast(offsets), "_ord_part").select(
        *df.columns, (F.col("_ord_off") + inside).cast("long").alias(name))
