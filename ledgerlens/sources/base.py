"""A metrics source: ``ReportFilter -> DataFrame`` with the filter as a pruning hint.

A source may use the filter to prune its scan (raw-column bounds, partition
pruning); the reports still apply the exact filter on top.  A plain DataFrame
is wrapped as a source that ignores the hint (Catalyst still pushes the
report's filters into its scan).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Union

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.filters import ReportFilter
from ledgerlens.sources.files import read_metrics_parquet, restricted_to_names

MetricsSource = Callable[[Union[ReportFilter, None]], DataFrame]


class FrameSource:
    """A fixed DataFrame as a source."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __call__(self, pushdown: ReportFilter | None = None) -> DataFrame:
        return self.df


class ParquetSource:
    """A metrics table written by ``write_metrics_parquet`` (partitioned by date).

    ``names`` is the folder of its ``write_servicer_names``, if there is one; a
    name filter then becomes one on servicer numbers before the facts are read.
    """

    #: Its dates are partitions, so the latest one is known without a scan.
    by_date = True

    def __init__(self, spark: SparkSession, path: str, names: str | None = None):
        self.spark, self.path, self.names = spark, path, names

    def __call__(self, pushdown: ReportFilter | None = None) -> DataFrame:
        facts = read_metrics_parquet(self.spark, self.path)
        if self.names is None or pushdown is None or not pushdown.servicer_name:
            return facts
        return restricted_to_names(facts, self.spark.read.parquet(self.names), pushdown)


def as_source(src: DataFrame | MetricsSource) -> MetricsSource:
    return FrameSource(src) if isinstance(src, DataFrame) else src
