"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset on one machine (tests), a new one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="claimspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_homes: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _leave(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # noqa: BLE001  the session has ended already; a shared folder is cleared by its owner
        pass


def folder(spark: SparkSession) -> str:
    """The application's folder in the shared one; its tables go when Python exits, if the session is still there."""
    home = f"{shared_dir(spark)}/claimspan/{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_leave, spark, home)
    return home


def remove(spark: SparkSession, path: str) -> None:
    """Delete what a step wrote in the application's folder."""
    if path.startswith(folder(spark)):
        _delete(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed in here go when it ends, not when the driver happens to collect its garbage. For writes: their plans are not executed again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage in a way that outlives any executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    with no_shuffle_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once no later step reads it."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/claimspan/" in parent:
            _delete(df.sparkSession, parent)
