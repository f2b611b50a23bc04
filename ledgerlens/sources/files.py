"""Metrics table as files: CSV read by header name, partitioned Parquet."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators.filters import ReportFilter, name_condition
from ledgerlens.schema import METRICS_COLUMNS, METRICS_SCHEMA

# The texts that the usual CSV reader of the Python world takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Date forms besides ISO dates and date-times.
DATE_FORMATS = ("M/d/yyyy", "yyyy/M/d", "yyyyMMdd")


def _converted(raw: Column, kind: str) -> Column:
    if kind == "string":
        return raw
    text = F.trim(raw)
    if kind == "date":
        # a date-time loses its time
        return F.coalesce(text.try_cast("timestamp_ntz").cast("date"),
                          *[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in DATE_FORMATS])
    if kind == "bigint":  # 12.0 is a whole number, 12.5 is not
        number = text.try_cast("decimal(38,10)")
        return F.coalesce(text.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))
    return text.try_cast(kind)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, text, odd``: every line with its split, its order inside it, and whether its quotes are odd.

    A line break is inside quotes if the quotes before it in the file are odd, doubled ones included.
    """
    text = F.col("value")
    quotes = F.length(text) - F.length(F.translate(text, '"', ""))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), text.alias("text"), (quotes % 2).alias("odd"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, header`` of CSV files whose quoted fields may hold line breaks, read by a task per split.

    Whether a split begins inside quotes follows from the parities of the splits before it (a row
    each).  Lines that are whole records pass; the lines of the others are put
    together by the place where their record begins, in whichever split.
    """
    lines = _lines(spark, path)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd")).select(
        "file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("opened"))
    inside = Window.partitionBy("file", "block").orderBy("line")
    before = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per split: safe to broadcast
    known = lines.join(F.broadcast(opened), ["file", "block"]).select(
        "file", "block", "line", "text", "odd", ((F.col("opened") + before) % 2 == 1).alias("within"),
        ((F.row_number().over(inside) == 1) & (F.col("block") == 0)).alias("header"))
    whole = known.where(~F.col("within") & (F.col("odd") == 0)).select("text", "header")
    parts = known.where(F.col("within") | (F.col("odd") == 1))
    start = F.when(~F.col("within"), F.struct("block", "line"))
    begun = parts.withColumn("begin", F.last(start, ignorenulls=True).over(inside))
    last = begun.groupBy("file", "block").agg(F.max("begin").alias("begin")).select(
        F.col("file").alias("of"), F.col("block").alias("at"), F.col("begin").alias("last"))
    splits = opened.select(F.col("file").alias("of"), F.col("block").alias("at")).join(last, ["of", "at"], "left")
    carried = splits.select("of", "at", F.last("last", ignorenulls=True).over(
        Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    placed = begun.join(F.broadcast(carried), (begun["file"] == carried["of"]) & (begun["block"] == carried["at"]))
    joined = placed.groupBy("file", F.coalesce("begin", "carried").alias("begin")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))),
                                 lambda x: x["text"]), "\n").alias("text"), F.max("header").alias("header"))
    every = whole.unionByName(joined.select("text", "header"))
    return every.select(F.regexp_replace("text", "\r$", "").alias("record"), "header").where(F.trim("record") != "")


def _parsed(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns of records; a file whose header differs from ``columns`` fails the query."""
    fields = ", ".join(f"`{c}` string" for c in columns)
    record = F.regexp_replace("record", "^\ufeff", "")
    row = F.from_csv(record, F.lit(fields), {"quote": '"', "escape": '"', "mode": "FAILFAST"})
    rows = records.select(row.alias("row"), "header")
    same = F.array(*[F.col("row").getField(c) for c in columns]) == F.array(*[F.lit(c) for c in columns])
    checked = F.when(F.col("header") & ~F.coalesce(same, F.lit(False)), F.raise_error(
        F.lit("the files have different headers")).cast("boolean")).otherwise(~F.col("header"))
    return rows.where(checked).select("row.*")


def read_metrics_csv(spark: SparkSession, path: str, null_tokens: Iterable[str] = MISSING_TOKENS,
                     multi_line: bool = True, split: bool = True) -> DataFrame:
    """Read metrics CSV: comma, UTF-8, columns found by their header name.

    Column order is free and further columns are ignored; a missing column
    raises ``ValueError``.  Quoted fields may hold commas, doubled quotes and
    (``multi_line``) line breaks; a first pass looks for lines with such breaks.
    Files that have them are still read by many tasks each (``csv_records``;
    their fields with a quote inside must be quoted, and headers have no line
    break), or by one task each without ``split``.
    ``null_tokens`` are missing in every column.  Dates may carry a time, which
    is dropped.  A value that does not fit its column's type fails the query
    with the column's name.  All files of a folder need the same header.
    """
    broken = multi_line and (not split or not _lines(spark, path).where("odd = 1").isEmpty())
    raw = (spark.read.option("header", True).option("encoding", "UTF-8")
           .option("quote", '"').option("escape", '"').option("multiLine", broken and not split)
           .option("enforceSchema", False).option("mode", "FAILFAST").csv(path))
    if broken and split:
        raw = _parsed(csv_records(spark, path), raw.columns)
    absent = [c for c in METRICS_COLUMNS if c not in raw.columns]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)} in the header")
    tokens = list(null_tokens)

    def column(name: str, kind: str) -> Column:
        text = F.col(f"`{name}`")
        given = F.when(text.isin(tokens), None).otherwise(text) if tokens else text
        value = _converted(given, kind)
        if kind == "string":
            return value.alias(name)
        problem = F.concat(F.lit(f"column {name}: not a {kind}: "), given)
        return F.when(given.isNotNull() & value.isNull(), F.raise_error(problem).cast(kind)).otherwise(value).alias(name)

    return raw.select(*[column(f.name, f.dataType.simpleString()) for f in METRICS_SCHEMA])


def read_metrics_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read a metrics table written by :func:`write_metrics_parquet`.

    Filters on ``business_date`` prune partitions; the other filters reach the
    Parquet reader as pushed filters.
    """
    return spark.read.schema(METRICS_SCHEMA).parquet(path).select(*METRICS_COLUMNS)


_KEYS = ("business_date", "servicer_number", "unique_id")


def latest_partition(df: DataFrame, flt: ReportFilter | None = None) -> date | None:
    """Greatest ``business_date`` within the filter's dates among the partitions of a written table.

    Reads the file names that Spark has listed, no file; None if there is none.
    """
    found = {m[1] for m in (re.search(r"/business_date=(\d{4}-\d\d-\d\d)/", f) for f in df.inputFiles()) if m}
    days = [d for d in map(date.fromisoformat, found)
            if flt is None or ((flt.start is None or d >= flt.start) and (flt.end is None or d <= flt.end))]
    return max(days, default=None)


def write_metrics_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                          partitions: int | None = None,
                          max_records_per_file: int = 5_000_000) -> None:
    """Write the metrics table partitioned by ``business_date``.

    Range partitioning on (date, number, id) keeps each task to a few dates
    while splitting a heavy date over several tasks; AQE sizes the ranges from
    the shuffle statistics unless ``partitions`` is given; files are capped in
    rows.  Rows are sorted by the same keys, so the statistics of a file's row
    groups and pages prune by servicer number.
    """
    rows = df.select(*METRICS_COLUMNS)
    ranged = rows.repartitionByRange(partitions, *_KEYS) if partitions else rows.repartitionByRange(*_KEYS)
    (ranged.sortWithinPartitions(*_KEYS)
     .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("business_date").parquet(path))


#: Servicer numbers that a name filter is turned into; beyond that it is a semi-join.
MOST_NUMBERS = 1000


def write_servicer_names(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The dictionary (number, name) of a metrics table, for :func:`restricted_to_names`."""
    df.select("servicer_number", "servicer_name").distinct().write.mode(mode).parquet(path)


def restricted_to_names(df: DataFrame, names: DataFrame, flt: ReportFilter | None,
                        most: int = MOST_NUMBERS) -> DataFrame:
    """``df`` without the servicers none of whose ``names`` match the filter's name.

    Names are matched on the dictionary, one row per servicer and name.  Up to ``most`` numbers
    become a predicate that reaches the fact scan, more of them a semi-join.
    It only prunes: a servicer may have other names, so the name filter itself stays.
    """
    if flt is None or not flt.servicer_name:
        return df
    matching = names.where(name_condition(F.col("servicer_name"), flt)).select("servicer_number").distinct()
    few = [r[0] for r in matching.limit(most + 1).collect()]
    number = F.col("servicer_number")
    if len(few) > most:
        wanted = matching.withColumnRenamed("servicer_number", "_wanted")
        return df.join(wanted, number.eqNullSafe(F.col("_wanted")), "left_semi")
    hit = number.isin([n for n in few if n is not None])
    return df.where(hit | number.isNull() if None in few else hit)


def write_metrics_csv(df: DataFrame, path: str, mode: str = "overwrite",
                      columns: Sequence[str] = METRICS_COLUMNS, null_token: str = "") -> None:
    """Write the metrics table as CSV with a header row (dates as yyyy-MM-dd).

    Doubles are written in a form that parses back to the same value;
    ``columns`` sets the column order and ``null_token`` what stands for missing.
    """
    (df.select(*columns).repartitionByRange(*_KEYS)
     .write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd")
     .option("escape", '"').option("nullValue", null_token).csv(path))
