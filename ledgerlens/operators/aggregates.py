"""Aggregations of the reports: KPI row, status counts, grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.rounding import cents, mean_percent, millions, rate_units
from ledgerlens.functions.text import iso_date
from ledgerlens.schema import STATUS_DOMAIN


def _domain_zeros(spark: SparkSession) -> DataFrame:
    """The fixed status domain with zero counts (three literal rows, JVM-side)."""
    rows = F.array(*[F.struct(F.lit(s).alias("metric_status"),
                              F.lit(0).cast("long").alias("count")) for s in STATUS_DOMAIN])
    return spark.range(1).select(F.inline(rows))


#: ``kind`` of a row of ``snapshot_parts``: grouping ids over (number, name, status).
PAIRS, STATUSES = 0b001, 0b110


def snapshot_parts(snapshot: DataFrame) -> DataFrame:
    """The snapshot's one aggregate pass, as two grouping sets told apart by ``kind``.

    A row per (number, name) and a row per status, NULL keys included; the KPI,
    the balance bars and the status shares follow from them.  Statuses meet in
    the map tasks, so their set sends a handful of rows per task.
    """
    keys = ["servicer_number", "servicer_name", "metric_status"]
    return snapshot.groupingSets([keys[:2], keys[2:]], *keys).agg(
        F.grouping_id(*keys).cast("int").alias("kind"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("loan_count").alias("loans"),
        F.sum(rate_units(F.col("delinquency_rate"))).alias("rate_units"),
        F.count("delinquency_rate").alias("rated"),
        F.sum(cents(F.col("total_balance_usd"))).alias("cents"),
        F.max("business_date").alias("as_of"))


def balance_parts(snapshot: DataFrame) -> DataFrame:
    """Cents and date per (number, name) alone, in the columns of ``snapshot_parts`` that the bars need."""
    return snapshot.groupBy("servicer_number", "servicer_name").agg(
        F.lit(PAIRS).alias("kind"), F.sum(cents(F.col("total_balance_usd"))).alias("cents"),
        F.max("business_date").alias("as_of"))


def status_parts(snapshot: DataFrame) -> DataFrame:
    """Rows and date per status alone, in the columns of ``snapshot_parts`` that the counts need."""
    return snapshot.groupBy("metric_status").agg(
        F.lit(STATUSES).alias("kind"), F.count(F.lit(1)).alias("rows"), F.max("business_date").alias("as_of"))


def status_counts(parts: DataFrame, zero_fill: bool = True) -> DataFrame:
    """Rows per status (NULL status dropped) of the parts; the fixed domain zero-filled.

    The zero rows are unioned and summed instead of joined, so there is no join.
    """
    seen = parts.where((F.col("kind") == STATUSES) & F.col("metric_status").isNotNull()).select(
        "metric_status", F.col("rows").alias("count"))
    if not zero_fill:
        return seen
    return seen.unionByName(_domain_zeros(parts.sparkSession)).groupBy("metric_status").agg(
        F.sum("count").cast("long").alias("count"))


#: log2 of the sketch's buckets: a relative standard error of about 1.04 / sqrt(2**12) = 1.6 %.
SKETCH_LG = 12


def servicer_sketches(rows: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """``business_date, rows, servicers``: a mergeable distinct-count sketch of the servicer numbers of each date.

    A few kilobytes per date whatever its rows, so kept sketches answer for any range of dates.
    """
    return rows.groupBy("business_date").agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("servicer_number", lg).alias("servicers"))


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """``rows, servicers`` (estimated) over all dates of ``servicer_sketches``."""
    merged = sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.hll_union_agg("servicers").alias("all"))
    return merged.select("rows", F.coalesce(F.hll_sketch_estimate("all"), F.lit(0)).alias("servicers"))


def approximate_kpi_row(snapshot: DataFrame, lg: int = SKETCH_LG) -> DataFrame:
    """``kpi_row`` straight from the snapshot with an estimated ``servicer_count``: one partial row per task.

    The exact count sends a row per servicer and task; everything else is exact here too.
    """
    status = F.col("metric_status")
    return _headline(snapshot.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.coalesce(F.sum("loan_count"), F.lit(0)).cast("long").alias("total_loans"),
        F.sum(rate_units(F.col("delinquency_rate"))).alias("_rate_units"),
        F.count("delinquency_rate").alias("_rated"),
        F.coalesce(F.sum(cents(F.col("total_balance_usd"))), F.lit(0)).alias("_cents"),
        F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg("servicer_number", lg)), F.lit(0)).alias("servicer_count"),
        *[F.count_if(status == F.lit(s)).alias(f"status_{s.lower()}") for s in STATUS_DOMAIN],
        F.max("business_date").alias("_as_of")))


def kpi_row(parts: DataFrame) -> DataFrame:
    """Headline numbers of ``snapshot_parts``; one row even when empty.

    total_loans, avg_delinquency_rate (%, 2 dp, unweighted mean over rows),
    total_balance_usd (USD millions, 1 dp), servicer_count (distinct numbers),
    status_green/yellow/red, as_of_date (NULL when empty).
    """
    return _kpi(parts)


def _kpi(parts: DataFrame, extra: Sequence[Column] = (), kept: Sequence[Column] = ()) -> DataFrame:
    status_cols = [
        F.coalesce(F.sum(F.when((F.col("kind") == STATUSES) & (F.col("metric_status") == F.lit(s)), F.col("rows"))),
                   F.lit(0)).alias(f"status_{s.lower()}")
        for s in STATUS_DOMAIN
    ]

    def paired(column: str) -> Column:
        return F.sum(F.when(F.col("kind") == PAIRS, F.col(column)))

    return _headline(parts.agg(
        *extra,
        F.coalesce(paired("rows"), F.lit(0)).alias("_rows"),
        F.coalesce(paired("loans"), F.lit(0)).cast("long").alias("total_loans"),
        paired("rate_units").alias("_rate_units"),
        paired("rated").alias("_rated"),
        F.coalesce(paired("cents"), F.lit(0)).alias("_cents"),
        # NULL in the rows of the status set, so they do not count
        F.count_distinct("servicer_number").alias("servicer_count"),
        *status_cols,
        F.max("as_of").alias("_as_of"),
    ), kept)


def _headline(agg: DataFrame, kept: Sequence[Column] = ()) -> DataFrame:
    return agg.select(
        "total_loans",
        F.when(F.col("_rows") == 0, F.lit(0.0))
        .otherwise(mean_percent(F.col("_rate_units"), F.col("_rated"), 2))
        .alias("avg_delinquency_rate"),
        millions(F.col("_cents"), 1).alias("total_balance_usd"),
        F.col("servicer_count").cast("long").alias("servicer_count"),
        *[F.col(f"status_{s.lower()}") for s in STATUS_DOMAIN],
        iso_date(F.col("_as_of")).alias("as_of_date"),
        *kept,
    )


def kpi_with_status_map(parts: DataFrame) -> DataFrame:
    """KPI row plus ``status_counts``: map of every status seen, domain zero-filled.

    The statuses (a row each in the parts) are gathered by the same aggregate as the KPI.
    """
    entry = F.struct(F.col("metric_status").alias("metric_status"), F.col("rows").alias("count"))
    seen = F.collect_list(F.when((F.col("kind") == STATUSES) & F.col("metric_status").isNotNull(), entry)).alias("_seen")
    names = F.transform("_seen", lambda e: e["metric_status"])
    zeros = F.array(*[F.struct(F.lit(s).alias("metric_status"), F.lit(0).cast("long").alias("count")) for s in STATUS_DOMAIN])
    unseen = F.filter(zeros, lambda e: ~F.array_contains(names, e["metric_status"]))
    counts = F.map_from_entries(F.array_sort(F.concat(F.col("_seen"), unseen)))
    return _kpi(parts, [seen], [counts.alias("status_counts")])
