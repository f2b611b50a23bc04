"""Metrics table derived from the TPC-H-style star schema.

Grain: supplier x ship month.  ``lineitem`` is aggregated first (partial
aggregation before the shuffle, so a hot supplier costs one row per map task),
then joined to ``supplier``/``nation``/``region``.  The joins carry no hints:
Spark broadcasts a dimension by its size in bytes or sort-merges it.

Filters on the derived columns cannot reach the scan by themselves
(``business_date`` is a month truncation, ``servicer_number`` a formatted
key), so :func:`star_metrics` also turns a :class:`ReportFilter` into raw
bounds on ``l_shipdate``/``l_suppkey``.  The exact filter is still applied by
the report on top; the raw bounds only prune.
"""

from __future__ import annotations

import re
import sys
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.filters import ReportFilter, name_condition
from ledgerlens.session import app_id
from ledgerlens.sources import files

# Fixed mapping choices of the adapter.
NUMBER_FORMAT = "SVC-%05d"
GREEN_BELOW = 0.25
YELLOW_BELOW = 0.5

_NUMBER_RE = re.compile(r"SVC-(\d+)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _month_start(d: date) -> date:
    return d.replace(day=1)


def _next_month(d: date) -> date:
    return date(d.year + (d.month == 12), d.month % 12 + 1, 1)


def _ntz(d: date) -> Column:
    return F.lit(d.isoformat()).cast("timestamp_ntz")


def suppkey_of(number: str) -> int | None:
    """Supplier key whose formatted number is exactly ``number``, if any."""
    m = _NUMBER_RE.fullmatch(number)
    if not m:
        return None
    key = int(m.group(1))
    return key if NUMBER_FORMAT % key == number else None


def shipdate_bounds(flt: ReportFilter | None) -> list[Column]:
    """Raw ``l_shipdate`` predicates implied by month-level date bounds.

    A month row passes ``start`` when its first day is on or after it, so its
    lines ship on or after the first month start >= ``start``; it passes
    ``end`` when its first day is on or before it, so its lines ship before the
    start of the month after ``end``'s month.
    """
    preds: list[Column] = []
    if flt is None:
        return preds
    if flt.start is not None:
        first = flt.start if flt.start.day == 1 else _next_month(flt.start)
        preds.append(F.col("l_shipdate") >= _ntz(first))
    if flt.end is not None:
        preds.append(F.col("l_shipdate") < _ntz(_next_month(_month_start(flt.end))))
    return preds


class StarSource:
    """The star-schema adapter as a metrics source (filters become scan bounds)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, pushdown: ReportFilter | None = None) -> DataFrame:
        return star_metrics(self.spark, self.sf_dir, pushdown)


STAR_TABLES = ["lineitem", "supplier", "nation", "region"]


_SOURCES: dict[tuple[str, ...], Any] = {}


def materialized_star(spark: SparkSession, sf_dir: str, fmt: str = "parquet", refresh: bool = False):
    """The adapter's table, written once per input and definition and reused.

    ``fmt="csv"`` writes a CSV copy instead, read back by header name.  The
    inputs are identified once per session (``refresh=True``: again).
    """
    from ledgerlens.sources.materialized import MaterializedSource, definition_digest, input_signature

    mine = (app_id(spark), sf_dir, fmt, definition_digest(sys.modules[__name__], files))
    if refresh or mine not in _SOURCES:
        inputs = input_signature(spark, (f"{sf_dir.rstrip('/')}/{t}.parquet" for t in STAR_TABLES))
        _SOURCES[mine] = MaterializedSource(
            spark, f"star-{inputs}-{mine[-1]}", lambda: star_metrics(spark, sf_dir), fmt)
    return _SOURCES[mine]


def star_metrics(spark: SparkSession, sf_dir: str,
                 pushdown: ReportFilter | None = None) -> DataFrame:
    """The metrics table (``METRICS_SCHEMA``) built from the star schema."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice")
    for pred in shipdate_bounds(pushdown):
        lines = lines.where(pred)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    if pushdown is not None and pushdown.servicer_number:
        key = suppkey_of(pushdown.servicer_number)
        if key is None:  # no supplier can carry this number
            lines = lines.where(F.lit(False))
        else:
            lines = lines.where(F.col("l_suppkey") == F.lit(key))
            supplier = supplier.where(F.col("s_suppkey") == F.lit(key))

    if pushdown is not None and pushdown.servicer_name:
        # Name filter: keep only the matching suppliers' lines before aggregating.
        matching = supplier.where(name_condition(F.col("s_name"), pushdown)).select("s_suppkey")
        lines = lines.join(matching, lines.l_suppkey == matching.s_suppkey, "left_semi")

    monthly = (
        lines.groupBy(
            F.col("l_suppkey"),
            F.trunc(F.to_date("l_shipdate"), "MM").alias("business_date"))
        .agg(
            F.count(F.lit(1)).alias("loan_count"),
            F.count_if(F.col("l_returnflag") == F.lit("R")).alias("delinquent"),
            # exact integer cents: a bigint sum, not a (slow) wide-decimal sum
            F.sum(F.round(F.col("l_extendedprice") * F.lit(100)).cast("long"))
            .alias("balance_cents"))
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (
        monthly.join(supplier, monthly.l_suppkey == supplier.s_suppkey)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    rate = F.col("delinquent") / F.col("loan_count")
    return joined.select(
        (F.col("s_suppkey") * F.lit(1_000_000)
         + F.year("business_date") * F.lit(100) + F.month("business_date"))
        .cast("long").alias("unique_id"),
        F.format_string(NUMBER_FORMAT, F.col("s_suppkey")).alias("servicer_number"),
        F.col("s_name").alias("servicer_name"),
        F.col("n_name").alias("tenant_id"),
        F.col("business_date"),
        F.col("r_name").alias("region"),
        F.col("loan_count").cast("long").alias("loan_count"),
        rate.cast("double").alias("delinquency_rate"),
        (F.col("balance_cents").cast("double") / F.lit(100.0)).alias("total_balance_usd"),
        F.when(rate < F.lit(GREEN_BELOW), F.lit("GREEN"))
        .when(rate < F.lit(YELLOW_BELOW), F.lit("YELLOW"))
        .otherwise(F.lit("RED")).alias("metric_status"),
    )


def messy_metrics(metrics: DataFrame) -> DataFrame:
    """``metrics`` with missing values in every column, renamed servicers and an unknown status.

    A fixed function of the row ids, to check how the reports treat such rows.
    """
    supplier = F.floor(F.col("unique_id") / F.lit(1_000_000))
    uid = F.col("unique_id")

    def unless(hit: Column, name: str) -> Column:
        return F.when(~hit, F.col(name))

    renamed = (supplier % 5 == 2) & F.coalesce(F.year("business_date") >= 1996, F.lit(False))
    changed = {
        "servicer_number": unless(supplier % 17 == 3, "servicer_number"),
        "servicer_name": F.when(supplier % 13 == 5, None).when(
            renamed, F.concat("servicer_name", F.lit(" (renamed)"))).otherwise(F.col("servicer_name")),
        "business_date": unless(uid % 41 == 7, "business_date"),
        "region": unless(supplier % 11 == 4, "region"),
        "loan_count": unless(uid % 19 == 1, "loan_count"),
        "delinquency_rate": unless(uid % 23 == 2, "delinquency_rate"),
        "total_balance_usd": unless(uid % 29 == 3, "total_balance_usd"),
        "metric_status": F.when(supplier % 7 == 1, "BLUE").when(supplier % 7 == 6, None).otherwise(
            F.col("metric_status")),
    }
    return metrics.withColumns(changed)
