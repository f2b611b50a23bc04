"""Binary files that tasks write and read by byte ranges.

Spark has no writer for formats of one's own, so tasks open the files
themselves.  The folder is qualified on the driver by Spark's own rules (a path
without a scheme belongs to the default file system, never to the disk of
whichever machine runs the task), and a scheme that tasks cannot open is an
error before any job starts.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession

from ledgerlens.llm._util import shared_path
from ledgerlens.session import qualified

#: Schemes that tasks can open, and their names there.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs",
           "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


def task_uri(uri: str) -> str:
    """The URI as tasks open it; raises ``ValueError`` for a scheme that they cannot open or none at all."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"{uri!r} names no file system; tasks on several machines would not share it")
    if scheme not in SCHEMES:
        raise ValueError(f"tasks cannot open {scheme}: files (known: {', '.join(sorted(SCHEMES))}); "
                         "point spark.checkpoint.dir at one of these")
    if scheme == "file":
        rest = "//" + "/" + rest.lstrip("/")
    return f"{SCHEMES[scheme]}:{rest}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage for files that tasks write themselves."""
    return task_uri(qualified(spark, shared_path(spark, name)))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI from ``shared_folder``."""
    return fs.FileSystem.from_uri(uri)
