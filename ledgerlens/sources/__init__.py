"""Sources of the metrics table."""

from ledgerlens.sources.files import read_metrics_csv, read_metrics_parquet, write_metrics_parquet
from ledgerlens.sources.star import star_metrics

__all__ = ["read_metrics_csv", "read_metrics_parquet", "star_metrics", "write_metrics_parquet"]
