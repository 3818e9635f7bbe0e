"""Tables written once and read by several steps, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without one, in local mode only, a temporary folder that goes when Python ends."""
    sc = spark.sparkContext
    if told := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return told.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="topicloom-")
        atexit.register(shutil.rmtree, _local[sc.applicationId], ignore_errors=True)
    return _local[sc.applicationId]


_local: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: computed once however often it is read, and kept when executors are lost."""
    df.write.option("compression", "zstd").parquet(path := new_path(df.sparkSession, name))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once all that reads it has been written itself, and lets Spark drop shuffle files of
    plans that nothing refers to any more."""
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(df.stored)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop such shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
