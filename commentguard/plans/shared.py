"""Intermediate tables in the folder that all machines of a session share."""

import atexit
import shutil
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

_RUN = f"run-{uuid.uuid4().hex}"
_ROOTS: set[str] = set()
#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or its warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this process."""
    root = shared_root(spark)
    _ROOTS.add(root)
    return f"{root}/commentguard/{_RUN}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    This cuts the lineage: a lost executor costs a read, not the work above it.
    So nothing reads the shuffle files of that work again, and Spark is told to
    remove them at once rather than when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: what came of them is written too."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._shared_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _remove() -> None:
    """Remove this process's tables where the shared folder is a mounted one."""
    for root in _ROOTS:
        if urlsplit(root).scheme in ("", "file"):
            shutil.rmtree(f"{urlsplit(root).path}/commentguard/{_RUN}", ignore_errors=True)
