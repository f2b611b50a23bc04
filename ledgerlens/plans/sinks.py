"""Sinks: long results as record files, chart traces as one JSON record per series."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write a result in parallel as JSON Lines or Parquet (one file per task)."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}")
    df.write.mode(mode).format(fmt).save(path)


def trace_records(nested: DataFrame, chart_type: str, title: str) -> DataFrame:
    """One JSON string per series: ``{"chartType", "title", "trace": {...}}``.

    Traces stay one per row, so a chart with many series is written in
    parallel instead of being gathered into one document.
    """
    trace_cols = [c for c in nested.columns]
    return nested.select(F.to_json(F.struct(
        F.lit(chart_type).alias("chartType"),
        F.lit(title).alias("title"),
        F.struct(*trace_cols).alias("trace"))).alias("value"))


def write_traces(nested: DataFrame, path: str, chart_type: str, title: str) -> None:
    trace_records(nested, chart_type, title).write.mode("overwrite").text(path)


def to_records(df: DataFrame) -> Iterator[dict]:
    """A result as Python records, one partition at a time on the driver, without a limit.

    For handing answers to a client; a large result is better written with
    :func:`write_dataset`.
    """
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)
