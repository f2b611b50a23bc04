"""Build a derived metrics table once, then serve every report from it.

The reference loads its table once and answers every request from memory.
Here the derived table is written once, partitioned by ``business_date``, to
the shared folder that the session names; later reports read it with partition
pruning and pushed filters.  A written table also cuts lineage, so a lost
executor never replays the source aggregation.

A table is keyed by its inputs (path, size and modification time of every
file, as Spark lists them) and by its definition (see ``definition_digest``),
so changed data or changed code gets a new table.  Every build writes to a
folder of its own and is then published by a small marker below the key;
nothing is overwritten or deleted, so any number of applications may build or
read at the same time.
"""

from __future__ import annotations

import hashlib
import inspect
import threading
import uuid
from collections.abc import Callable, Iterable
from types import ModuleType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.filters import ReportFilter
from ledgerlens.schema import METRICS_SCHEMA
from ledgerlens.session import app_id, shared_root
from ledgerlens.sources.files import (
    read_metrics_csv, read_metrics_parquet, restricted_to_names, write_metrics_csv, write_metrics_parquet,
    write_servicer_names)

#: What a published name stands for: a table and, for Parquet, its servicer names beside it.
LAYOUT = "named"
_READ: dict[tuple[str, str], tuple[DataFrame, str]] = {}
_LOCK = threading.RLock()


def input_signature(spark: SparkSession, paths: Iterable[str]) -> str:
    """Digest of the files below ``paths``: names, sizes and modification times.

    The listing is Spark's own (no content is read), so it works on any store;
    it is summed up on the executors and one row reaches the driver.
    """
    h = hashlib.sha256()
    for path in sorted(paths):
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                 .select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"), "length"))
        h.update(f"{path}|{tuple(files.agg(F.count('h'), F.sum('h'), F.sum('length')).first())}".encode())
    return h.hexdigest()[:16]


def definition_digest(*modules: ModuleType) -> str:
    """Digest of what defines a table: the modules' source, their constants as they are now, and the schema."""
    h = hashlib.sha256(METRICS_SCHEMA.json().encode())
    for module in modules:
        h.update(inspect.getsource(module).encode())
        h.update(repr(sorted((k, v) for k, v in vars(module).items()
                             if k.isupper() and isinstance(v, (int, float, str, tuple, list)))).encode())
    return h.hexdigest()[:16]


def stored_small(df: DataFrame, name: str) -> DataFrame:
    """Write an aggregated table to the shared folder and read it back, with its true size known."""
    path = f"{shared_root(df.sparkSession)}/ledgerlens-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class MaterializedSource:
    """A metrics source built by ``build()`` on first use and read back after."""

    def __init__(self, spark: SparkSession, key: str, build: Callable[[], DataFrame],
                 fmt: str = "parquet"):
        if fmt not in ("parquet", "csv"):
            raise ValueError(f"unsupported format {fmt!r}")
        self.spark, self.key, self.build, self.fmt = spark, key, build, fmt

    @property
    def home(self) -> str:
        return f"{shared_root(self.spark)}/ledgerlens-tables/{self.key}-{self.fmt}-{LAYOUT}"

    @property
    def by_date(self) -> bool:
        """Whether dates are partitions, so that the latest one is known without a scan."""
        return self.fmt == "parquet"

    def published(self) -> str | None:
        """Folder of a finished table, the first by name if several were built; None if there is none."""
        try:
            found = self.spark.read.text(f"{self.home}/published/*/part-*").agg(F.min("value")).first()[0]
        except AnalysisException:
            return None
        return f"{self.home}/{found}" if found else None

    def _build(self) -> str:
        name = f"table-{uuid.uuid4().hex}"
        write = write_metrics_parquet if self.fmt == "parquet" else write_metrics_csv
        write(self.build(), f"{self.home}/{name}")
        if self.fmt == "parquet":
            write_servicer_names(read_metrics_parquet(self.spark, f"{self.home}/{name}"), f"{self.home}/{name}-names")
        marker = self.spark.range(1).select(F.lit(name).alias("value")).coalesce(1)
        marker.write.text(f"{self.home}/published/{name}")
        return f"{self.home}/{name}"

    def _opened(self) -> tuple[DataFrame, str]:
        """The built table and its path; one DataFrame per session, so its file
        listing (partition discovery) is done once, not per report."""
        cached = (app_id(self.spark), self.home)
        with _LOCK:
            if cached not in _READ:
                path = self.published() or self._build()
                read = read_metrics_csv if self.fmt == "csv" else read_metrics_parquet
                _READ[cached] = read(self.spark, path), path
            return _READ[cached]

    def table(self) -> DataFrame:
        return self._opened()[0]

    def __call__(self, pushdown: ReportFilter | None = None) -> DataFrame:
        # Date filters prune partitions and the number reaches the Parquet reader
        # through Catalyst; a name is turned into numbers first.
        facts, path = self._opened()
        if self.fmt != "parquet" or pushdown is None or not pushdown.servicer_name:
            return facts
        return restricted_to_names(facts, self.spark.read.parquet(f"{path}-names"), pushdown)
