"""What the operators share: the shared folder, written tables, ranks without one large task, links to components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word, as the contracts give it.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    sc = spark.sparkContext
    if (told := sc.getConf().get("spark.checkpoint.dir")) or (told := sc.getCheckpointDir()):
        return told.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what table() wrote, once all that reads it has been written itself. Other frames are left alone."""
    for df in tables:
        if path := df.__dict__.get("stored"):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Plans made and run inside hand at most so many rows at once to a Python worker; for rows of some kilobytes each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(col) -> F.Column:
    """Number of words of a text; 0 of null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, part: list[str], spread: list[str], order: list[str], rows: int, name: str = "rank") -> DataFrame:
    """df with the rank from 0 of each row among those with equal `part`.

    Rows are dealt to at least 1024 buckets by the hash of `spread`; each bucket is numbered alone and starts where
    the sums of the buckets before it end. So no task gets more than a bucket of about 50,000 rows.
    """
    buckets = max(1024, rows // 50_000)
    df = df.withColumn("_b", F.pmod(F.xxhash64(*spread, F.lit(91)), F.lit(buckets)))
    at = df.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    at = at.select(*part, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_bucket = Window.partitionBy(*part, "_b").orderBy(*order)
    df = df.withColumn("_k", F.row_number().over(in_bucket))
    return df.join(at, [*part, "_b"]).withColumn(name, (F.col("_start") + F.col("_k") - 1).cast("long")).drop("_b", "_start", "_k")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node that a link names.

    Each round every node takes the smallest root among its own and its neighbours', and then that root's root.
    Rounds run as joins over written tables until nothing changes; a chain of n links takes about log n rounds.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = table(both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = table(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("root").alias("r")), "y").groupBy(F.col("x").alias("node")).agg(F.min("r").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # the old root learns of the smaller one too, so that whole trees move at once
        learnt = hooked.select(F.col("old").alias("node"), "root").groupBy("node").agg(F.min("root").alias("told"))
        hooked = hooked.join(learnt, "node", "left").select("node", "old", F.least("root", F.coalesce("told", "root")).alias("root"))
        hooked = table(hooked, "labels")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        after = table(hooked.join(up, "root", "left").select("node", "old", F.coalesce("up", "root").alias("root")), "labels")
        discard(labels, hooked)
        labels = after
        if labels.where("root <> old").isEmpty():
            discard(both)
            return labels.select("node", "root")


def pack(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
