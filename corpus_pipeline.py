"""A corpus from documents: language, near copies, repeated passages, mixture, packing.

Each stage takes what the one before wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import common, langid, mixing, ngram_join, packing, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no letter is in it, or if no language holds this much of its bytes' probability.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang becomes the predicted one where it was null."""
    known = langid.predict(docs.select(*COLUMNS), langid.train(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id, null last;
    rows that repeat an id and a text count once. Equal ids on texts that no links join are documents of their own, and so
    are null ids."""
    joined = ngram_join.linked(docs, width=5, threshold=80)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    keep = joined.where("root is not null").groupBy("root").agg(first).select("one.doc_id", "one.text_hash")
    keep = keep.union(joined.where("root is null").select("doc_id", "text_hash")).distinct()
    # the keys have no nulls, so that join and deduplication share one shuffle of the texts
    key = {"_id": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull(), "_text": F.col("text_hash")}
    keep = common.table(keep.select(*(v.alias(k) for k, v in key.items())), "kept-documents")
    held = docs.select(*COLUMNS).withColumns(key | {"_text": F.xxhash64("text")})
    return held.join(keep, list(key), "left_semi").dropDuplicates(list(key)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; a cut within a character drops its rest. Texts of which no
    word is left go."""
    done = suffix_dedup.remove(docs.select(*COLUMNS), as_text=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    done = done.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return done.where((F.col("n_removed") == 0) | F.col("text").rlike(common.WORD)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mixture takes a document, in the order of its shard; a shard is a run of files."""
    return mixing.in_shards(mixing.mix(docs.select(*COLUMNS)), list(COLUMNS))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("bins", bins)]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
