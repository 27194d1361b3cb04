"""Intermediate tables in the shared folder of the cluster.

A step that later jobs read several times is written as Parquet. That cuts its
lineage - a lost executor costs a re-read, not a recomputation - and gives the
optimizer the real size of the table.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_scope: ContextVar[str] = ContextVar("scope", default="")


def scratch_root(spark: SparkSession) -> str:
    """Shared folder from the session; a temporary one only in local mode."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_root()
    raise ValueError(f"set {SETTING} to a folder all executors can reach")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tonelab-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder.

    Tables of one application share a folder named by its id, so they can be
    removed together once it has ended.
    """
    application = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/tonelab/{application}/{_scope.get()}{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[str]:
    """All paths taken inside share a folder, so that they can be removed together; an error removes it."""
    folder = scratch_path(spark, name)
    token = _scope.set(f"{_scope.get()}{folder.rsplit('/', 1)[1]}/")
    try:
        yield folder
    except BaseException:
        remove(spark, folder)
        raise
    finally:
        _scope.reset(token)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch_path`` or ``scope`` named."""
    if f"/tonelab/{spark.sparkContext.applicationId}/" not in path:
        raise ValueError(f"not a scratch folder of this application: {path}")
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def publish(spark: SparkSession, part: str, path: str) -> None:
    """Give a finished folder its name in one step, so no reader sees half of it."""
    target, files = _hadoop(spark, path)
    if files.exists(target):
        raise FileExistsError(path)
    if not files.rename(_hadoop(spark, part)[0], target):
        raise OSError(f"cannot rename {part} to {path}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
