"""Sparse document-term tables: from folders of shard files, from text, or from any two key columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import shard_label

TRIPLETS = "doc_id long, term_id int, count int"
#: Document ids that are numbered together.
STRETCH = 4096


def natural(label: str) -> list:
    """Sort key of a label on the driver."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", label or "") if p]


@dataclass
class Dtm:
    """docs (any columns), terms (any columns), counts (shard, entry_id, doc_id, term_id, count)."""

    docs: DataFrame
    terms: DataFrame
    counts: DataFrame

    def dims(self) -> tuple[int, int]:
        """Numbers of documents and of terms."""
        return self.docs.count(), self.terms.count()

    def shards(self) -> list[str]:
        """Labels in natural order."""
        return sorted((r.shard for r in self.counts.select("shard").distinct().collect()), key=natural)


def read_dtm(spark: SparkSession, path: str, ftype: str = "csv", parts: Sequence[str] | None = None) -> Dtm:
    """Folder with doc*, term* and count* files. parts: labels of the shards to read.

    Parquet rows keep their place in the file as entry_id. CSV rows are numbered as Spark reads them; with a file per
    shard that is their order, too. doc_id counts from the least of its shard.
    """
    if ftype not in ("csv", "pq"):
        raise ValueError(f"ftype must be csv or pq, not {ftype!r}")

    def read(glob: str, schema: str | None = None) -> DataFrame:
        reader = spark.read.option("pathGlobFilter", glob)
        if ftype == "pq":
            return reader.parquet(path)
        reader = reader.option("header", True).option("mode", "FAILFAST").option("enforceSchema", True)
        return (reader.schema(schema) if schema else reader).csv(path)

    def glob(kind: str) -> str:
        return f"{kind}_{{{','.join(parts)}}}.{ftype}" if parts else f"{kind}*.{ftype}"

    raw = read(glob("count"), TRIPLETS)
    names = raw.columns[:3]
    place = F.col("_metadata.row_index") if ftype == "pq" else F.monotonically_increasing_id()
    counts = raw.select(shard_label(F.col("_metadata.file_name")).alias("shard"), place.alias("place"), *(F.col(n).cast(t).alias(a) for n, t, a in zip(names, ("long", "int", "int"), ("doc_id", "term_id", "count"))))
    order = Window.partitionBy("shard").orderBy("place")
    counts = counts.withColumn("entry_id", (F.row_number().over(order) - 1).cast("long")).drop("place")
    return Dtm(read(glob("doc")), read(f"term*.{ftype}"), rebase(counts).select("shard", "entry_id", "doc_id", "term_id", "count"))


def rebase(counts: DataFrame) -> DataFrame:
    """doc_id less the least of its shard."""
    least = F.min("doc_id").over(Window.partitionBy("shard"))
    return counts.withColumn("doc_id", F.col("doc_id") - least)


def check(counts: DataFrame, terms: int) -> DataFrame:
    """One row: numbers of entries with a null, a term out of range or a negative count."""
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias
    return counts.agg(bad(F.col("doc_id").isNull() | F.col("term_id").isNull() | F.col("count").isNull())("nulls"), bad((F.col("term_id") < 0) | (F.col("term_id") >= terms))("out_of_range"), bad(F.col("count") < 0)("negative"))


def triplets(df: DataFrame, shard: Column, doc: Column, term: Column) -> DataFrame:
    """(shard, doc_id, term, count) of any table, a row per occurrence of a term."""
    return df.select(shard.cast("string").alias("shard"), doc.cast("long").alias("doc_id"), term.cast("string").alias("term")).groupBy("shard", "doc_id", "term").agg(F.count(F.lit(1)).alias("count"))


def text_triplets(docs: DataFrame, shard: Column, text: str = "text") -> DataFrame:
    """Words of a to z in lower case.

    Texts are dealt by shard and document before they are split: that is less to shuffle than their words, and the
    words are then counted where they are.
    """
    rows = docs.select(shard.cast("string").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).repartition("shard", "doc_id")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return rows.select("shard", "doc_id", word.alias("term")).groupBy("shard", "doc_id", "term").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(counts: DataFrame, size: int | None = None) -> DataFrame:
    """(term, tf, term_id), the commonest term first, equal ones by text. size: keep the commonest only.

    Terms are numbered within (tf, first letters); a small table of those groups gives where each starts.
    """
    tf = counts.groupBy("term").agg(F.sum("count").alias("tf")).withColumn("head", F.substring("term", 1, 3))
    groups = tf.groupBy("tf", "head").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.col("tf").desc(), "head").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("tf", "head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("tf", "head").orderBy("term"))
    out = tf.withColumn("inner", inner).join(groups, ["tf", "head"]).select("term", "tf", (F.col("start") + F.col("inner") - 1).cast("long").alias("term_id"))
    return out if size is None else out.where(F.col("term_id") < size)


def entries(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(shard, entry_id, doc_id, term_id, count), numbered within the shard by document and term."""
    return numbered(coded(counts, terms))


def coded(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """(shard, doc_id, term_id, count)."""
    return counts.join(terms.select("term", "term_id"), "term").select("shard", "doc_id", "term_id", "count")


def numbered(joined: DataFrame) -> DataFrame:
    """coded() with entry_id.

    Runs of STRETCH document ids are numbered alone, so a large shard is many tasks; a row for each run says where it
    starts in its shard.
    """
    run = F.coalesce(F.floor(F.col("doc_id") / STRETCH), F.lit(-(1 << 62)))  # null ids come first
    joined = joined.withColumn("_run", run)
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = joined.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("_n"))
    runs = runs.select(F.col("shard").alias("_of"), F.col("_run").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_run").orderBy("doc_id", "term_id")
    rows = joined.withColumn("_k", F.row_number().over(order) - 1)
    # runs have a row for each 4096 documents of a shard; without the hint the entries would be dealt out once more
    rows = rows.join(F.broadcast(runs), F.col("shard").eqNullSafe(F.col("_of")) & (F.col("_run") == F.col("_at")))
    return rows.select("shard", (F.col("_start") + F.col("_k")).cast("long").alias("entry_id"), "doc_id", "term_id", "count")
