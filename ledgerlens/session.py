"""Session helpers.

The library never builds its own session inside operators: a session is
passed in.  ``local_session`` is for tests and the benchmark only.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``
(any file system Spark can write; the URI is used as it stands).  A scratch
folder of our own is made only on a local master with the setting unset, as in
tests; on a cluster a missing setting raises, since a machine-local folder
would hold each executor's part on its own disk.  ``scratch_scope`` deletes the
tables written inside it.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "ledgerlens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a scratch one only where that is
    unset and the master is local (driver and executors are one process)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(
            f"spark.checkpoint.dir is unset on master {master!r}: set it to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:      # the setting itself cannot change in a running application
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    return _LOCAL_ROOTS[app]


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer (any URI scheme)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(jvm_path, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete every intermediate table written inside the block when it ends.

    Results built inside are lazy plans over those tables: write or collect them
    before the block ends."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not paths]
        for path in paths:
            delete_path(spark, path)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read it
    back: one job, the lineage stops here (a lost executor recomputes nothing
    before it), and later plans get real file sizes for their join choices."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage_of(spark: SparkSession, build: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """``cut_lineage`` of the table that ``build`` returns.  The tables written while it is built
    and written are deleted then, so that they take no disk beside what follows; ``build``'s plan
    must not be used elsewhere."""
    path = scratch_dir(spark, name)
    with scratch_scope(spark):
        df = build()
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
