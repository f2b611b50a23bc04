"""Session helpers: a local session for tests/bench, and the checkpoint folder rule."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens", checkpoint_dir: str | None = None) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own config."""
    builder = SparkSession.builder.master(f"local[{cpus}]")
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return (
        builder
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_CHECKPOINT_LOCK = threading.Lock()
#: Rows that executors write to try a folder out, and the folders that passed (by application).
_TRIAL_ROWS = 1 << 14
_SHARED: set[tuple[str, str]] = set()
_SHARED_LOCK = threading.Lock()


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (also without a SparkContext)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session
        return spark.conf.get("spark.app.id", None) or "spark-connect"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark gives it: its own, else that of the default file system."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001 - no public call resolves a path
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    except AttributeError:  # a Spark Connect session has no JVM at hand
        return path
    return system.makeQualified(place).toString()


def _checked(root: str, master: str) -> str:
    """``root`` unless its name is that of a machine-local folder on a real cluster."""
    scheme = root.split(":", 1)[0] if "://" in root or root.startswith("file:") else ""
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"{root!r} is local to each machine; spark.checkpoint.dir must be shared storage")
    return root.rstrip("/")


def _rows_seen(spark: SparkSession, root: str) -> int:
    """Of ``_TRIAL_ROWS`` that tasks on all cores write below ``root``, those that a later job finds there."""
    path = f"{root.rstrip('/')}/ledgerlens-tables/trial-{uuid.uuid4().hex}"
    rows = spark.range(_TRIAL_ROWS)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count()


def _proved(spark: SparkSession, root: str, master: str) -> str:
    """``root``, unless it is local to each machine of a real cluster.

    A ``file:`` folder can be a network mount that all machines have, which its
    name does not tell: it is tried out once per application.
    """
    try:
        return _checked(root, master)
    except ValueError as refused:
        with _SHARED_LOCK:
            tried = (app_id(spark), root)
            if tried not in _SHARED:
                try:
                    seen = _rows_seen(spark, root)
                except Exception as failed:  # noqa: BLE001 - a machine lacks the folder, or another one's files
                    raise refused from failed
                if seen != _TRIAL_ROWS:
                    raise refused
                _SHARED.add(tried)
    return root.rstrip("/")


def shared_root(spark: SparkSession) -> str:
    """The shared folder for tables the library writes: ``spark.checkpoint.dir`` as the session has it.

    Only a local-mode session without the setting (tests) gets a fresh folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return _proved(spark, qualified(spark, configured), spark.conf.get("spark.master", "local"))
    return ensure_checkpoint_dir(spark).rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage; it is
    read from the session and used as is.  Only a local-mode session with no
    setting at all (tests) gets a fresh folder of its own.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's setting applies
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set on the server") from None
        return configured
    with _CHECKPOINT_LOCK:
        return _set_checkpoint_dir(spark, sc)


def _set_checkpoint_dir(spark: SparkSession, sc) -> str:
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(_proved(spark, configured, sc.master))
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage "
            "before running reports that cut lineage")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-ckpt-"))
    return sc.getCheckpointDir()
