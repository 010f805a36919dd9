"""Intermediate tables of operators that work in rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

_known: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, deleted when its driver ends.

    Where that is unset, a driver that runs all tasks itself takes a temporary
    folder; with executors elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/stratalog-rounds/{spark.sparkContext.applicationId}"
    if folder not in _known:
        _known.add(folder)
        atexit.register(_forget, spark, folder)
    return folder


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except (Py4JError, Py4JNetworkError, OSError, AttributeError):  # the JVM ended first
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table and read again: what is lost repeats from here on."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
