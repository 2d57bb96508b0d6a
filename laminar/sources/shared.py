"""Tables written to the folder that driver and executors share, named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, as in tests, a temporary one of this process.

    On a cluster a folder of this machine would hide what executors write, so there the setting is needed.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="laminar-"))
    return _FALLBACK[0]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path there, removed when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet there and read again, so that its plan runs once and is cut off."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a materialized table that nothing reads any more, as the round before last of a loop."""
    if path := _WRITTEN.pop(df, None):
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
