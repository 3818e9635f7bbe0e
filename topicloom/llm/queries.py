"""The queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, html_text, langid, mixing, nearest, ngram_join, packing, sharding, suffix_dedup, tokenfile
from .common import load

TOKENIZER = "byte_bpe_50k.json"


def op1_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return tokenfile.documents(tokenfile.write(load(spark, sf_dir, "documents"), tokenizer))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.train(docs)
    held = langid._held_out().alias("held_out")
    return langid.predict(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score", "n_bytes", "n_agree")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(load(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.transform("_copies", lambda c: c.shard).alias("shards"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, coder = nearest.index(load(spark, sf_dir, "embeddings"))
    return nearest.search(codes, coder, codes.where(F.col("vec_id") % 100 == 0))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.label_propagation_shards(load(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_file, op2_language, op3_fingerprint, op4_packing, op5_mixing, op6_nearest, op7_suffix_dedup, op8_main_text, op9_sharding, op10_ngram_join)}

#: Queries that DuckDB answers on whole tables.
ORACLE_SQL: dict[str, str] = {}
