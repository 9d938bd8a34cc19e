"""Session defaults and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_scopes: dict[str, str] = {}


def build_session(app: str = "manualdex", cores: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark; on a cluster the session is given."""
    n = cores or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a session of one process (``local[n]``) that names none gets a temporary folder; every other
    session must name one that all executors can reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_roots.get(sc.applicationId)
        if root is None:
            root = tempfile.mkdtemp(prefix="manualdex-")
            _local_roots[sc.applicationId] = root
    return root.rstrip("/")


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[str]:
    """Everything that is written with ``run_folder`` and ``cut_lineage`` inside goes into one folder,
    which is removed at the end; results must have been used or written elsewhere by then."""
    app = spark.sparkContext.applicationId
    before, folder = _scopes.get(app), f"{shared_root(spark)}/run-{uuid.uuid4().hex}"
    _scopes[app] = folder
    try:
        yield folder
    finally:
        if before is None:
            del _scopes[app]
        else:
            _scopes[app] = before
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, where it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lasting_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root that no run removes, for tables kept beside the catalog."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the current run, or below the shared root outside of one."""
    root = _scopes.get(spark.sparkContext.applicationId) or shared_root(spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Later steps survive lost executors without repeating the earlier ones, read only the
    columns they need, and are planned with the real size of the table.
    """
    spark = df.sparkSession
    path = run_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
