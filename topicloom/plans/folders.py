"""From a folder of shards to a folder of a fitted model, in one call."""

from __future__ import annotations

import logging
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..operators.sweep import Config
from ..sources import Dtm, read_dtm
from ..sources.sinks import column_shards, dense_csv, dense_shards, read_fixed_counts
from .fit import fit, fit_online, log, place

KINDS = ("sequential", "distributed", "online")


@contextmanager
def logged(log_file: str | None):
    """Appends what the fits log to a file of the driver, if one is named."""
    if log_file is None:
        yield
        return
    handler, level = logging.FileHandler(log_file), log.level
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        yield
    finally:
        log.removeHandler(handler)
        log.setLevel(level)
        handler.close()


def fit_folder(spark: SparkSession, dtm_dir: str, out_dir: str, topics: int, kind: str = "distributed", niters: int = 500, alpha: float = 1.0, beta: float = 1.0, unit: str = "entry", omega: float = 1.0, merge_every: int = 1, write_every: int = 0, aggregate_last: int = 0, ftype: str = "csv", parts: list[str] | None = None, nw_file: str | None = None, log_file: str | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """Reads doc*, term* and count* files, fits, and writes the model as comma text; returns its tables.

    kind: sequential, distributed or online. nw_file: topic counts that are never changed. log_file: a file of the
    driver for the log lines; "out_dir" names it after the last part of out_dir. Written below out_dir: nd, z, z_trace
    and, with aggregate_last, ndfinagg, each with a folder shard=<label> for each shard; nw and nwfinagg with a line a
    topic; online nw with a folder for each shard, of the decayed sums up to it. With write_every the tables of a fit
    are also written as Parquet to out_dir/tables while it runs.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind!r}")
    dtm = read_dtm(spark, dtm_dir, ftype, parts)
    terms = dtm.terms.count()
    cfg = Config(topics=topics, terms=terms, alpha=alpha, beta=beta, seed=seed)
    fixed = read_fixed_counts(spark, nw_file) if nw_file else None
    with logged(os.path.basename(out_dir.rstrip("/")) + ".txt" if log_file == "out_dir" else log_file):
        if kind == "online":
            ids = spark.range(terms).select(F.col("id").cast("int").alias("term_id"))
            model = fit_online(dtm.counts, ids, cfg, niters, omega)
        else:
            model = fit(dtm.counts, cfg, niters, merge_every, fixed, unit, kind == "sequential", write_every, f"{out_dir}/tables", aggregate_last)
        write_model(model, dtm, cfg, out_dir)
    return model


def write_model(model: dict[str, DataFrame], dtm: Dtm, cfg: Config, out_dir: str) -> None:
    """The text files of a fitted model, as fit_folder tells them."""
    z = model["z"]
    # every document of a shard has a line, those without entries too
    docs = z.groupBy("shard").agg(F.max("doc_id").alias("last")).select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("doc_id"))
    nd = z.groupBy("shard", "doc_id", F.col("z").alias("k")).agg(F.sum("count").alias("n"))
    dense_shards(nd, "doc_id", "k", "n", cfg.topics, f"{out_dir}/nd", docs)
    column_shards(z, "entry_id", "z", f"{out_dir}/z")
    if "z_trace" in model:
        column_shards(model["z_trace"], "iter", "changed", f"{out_dir}/z_trace")
    if "nd_aggregate" in model:
        dense_shards(model["nd_aggregate"], "doc_id", "k", "n", cfg.topics, f"{out_dir}/ndfinagg", docs)
        dense_csv(_all_topics(model["nw_aggregate"], cfg), "k", "term_id", "n", cfg.terms, f"{out_dir}/nwfinagg")
    if "nw_hist" in model:
        labels = sorted((r.shard for r in z.select("shard").distinct().collect()), key=place)
        told = z.sparkSession.createDataFrame(list(enumerate(labels)), "t int, shard string")
        topics = told.select("shard", F.explode(F.sequence(F.lit(0), F.lit(cfg.topics - 1))).alias("k"))
        dense_shards(model["nw"].join(F.broadcast(told), "t"), "k", "term_id", "n", cfg.terms, f"{out_dir}/nw", topics)
    else:
        dense_csv(_all_topics(model["nw"], cfg), "k", "term_id", "n", cfg.terms, f"{out_dir}/nw")


def _all_topics(nw: DataFrame, cfg: Config) -> DataFrame:
    """nw with a row at least for each topic."""
    none = nw.sparkSession.range(cfg.topics).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("term_id"), F.lit(0).alias("n"))
    return nw.select("k", "term_id", "n").unionByName(none).groupBy("k", "term_id").agg(F.sum("n").alias("n"))
