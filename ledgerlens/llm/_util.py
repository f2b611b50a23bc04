"""Shared-folder tables and small numpy helpers used by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import shared_root

U64 = np.uint64


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts lineage).

    A later executor loss re-reads the table instead of replaying the plan, and
    the planner sees the table's true size (it broadcasts small ones by itself).
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit("/", 2)[-2] != "llm":
            raise ValueError(f"{folder} is no table of the shared folder")
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001 - no public call deletes a path
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)  # noqa: SLF001
        except AttributeError:  # a Spark Connect session has no JVM at hand: the table stays
            return


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Python functions get at most ``rows`` rows at once (of long texts, 10,000 fill a worker)."""
    with _at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows):
        yield


@contextmanager
def long_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, at most ``rows`` rows of Parquet files are read and given to Python functions at once."""
    with _at_most(spark, "spark.sql.parquet.columnarReaderBatchSize", rows), arrow_batches(spark, rows):
        yield


@contextmanager
def _at_most(spark: SparkSession, name: str, rows: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spans(sizes: Sequence[int], budget: int) -> Iterator[tuple[int, int]]:
    """Cut ``0..len(sizes)`` into runs of at most ``budget`` in total (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union the pairs ``(i, j)`` into ``parent`` (smallest index is the root)."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return parent
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
