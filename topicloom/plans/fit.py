"""Fits: sequential, distributed with periodic merges, with fixed topics, and online over ordered shards."""

from __future__ import annotations

import logging
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as ops
from ..operators.sweep import Config, sweep, traces
from ..sources import natural
from ..sources.sinks import write_tables

log = logging.getLogger("topicloom")


def schedule(niters: int, merge_every: int = 1, write_every: int = 0, aggregate_last: int = 0) -> list[tuple[int, bool, bool, bool]]:
    """(sweep, merge, write, aggregate): merges after every merge_every-th sweep but the first, and after the last."""
    last = niters - 1
    due = lambda s, every: s == last or every > 0 and s % every == 0 and s != 0
    return [(s, due(s, merge_every), due(s, write_every), aggregate_last > 0 and s >= niters - aggregate_last) for s in range(niters)]


def _cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage where the session has a checkpoint folder, else keeps the rows in memory."""
    if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir"):
        return df.checkpoint()
    return df.persist()


def tables(entries: DataFrame, model: dict) -> dict[str, DataFrame]:
    out = {"z": entries, "nd": ops.nd(entries), "ndsum": ops.ndsum(entries), "nw": model.get("fixed") if model.get("fixed") is not None else ops.nw(entries)}
    out["nwsum"] = out["nw"].groupBy("k").agg(F.sum("n").alias("n"))
    return out | {k: v for k, v in model.items() if k in ("z_trace", "nw_aggregate", "nd_aggregate")}


def fit(entries: DataFrame, cfg: Config, niters: int = 500, merge_every: int = 1, fixed: DataFrame | None = None, unit: str = "entry", sequential: bool = False, write_every: int = 0, out: str | None = None, aggregate_last: int = 0, alpha: DataFrame | None = None, beta: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables z, nd, ndsum, nw, nwsum, z_trace, and sums over the last sweeps.

    entries: shard, entry_id, doc_id, term_id, count. sequential: all shards, in natural order, are one scan. Otherwise
    each shard scans by itself and counts are merged by the schedule. With fixed, nw is never changed.
    alpha (doc_id, k, a) and beta (k, term_id, b) replace the constant priors; with sequential, doc_id is as one_shard has it.
    """
    if unit not in ("entry", "token"):
        raise ValueError(f"unit must be entry or token, not {unit!r}")
    if sequential:
        entries, cfg = one_shard(entries), replace(cfg, key=("origin", "doc_id", "term_id"))
    state = ops.init_z_uniform(entries, cfg.topics, cfg.seed, *cfg.key)
    if unit == "token":
        state = ops.tokens(state)
        cfg = replace(cfg, key=(*cfg.key, "copy"))
    state = _cut(state)
    traced: list[DataFrame] = []
    model: dict = {"fixed": fixed}
    start = 1
    for s, merge, write, aggregate in schedule(niters, merge_every, write_every, aggregate_last):
        if not (merge or write or aggregate):
            continue
        swept = _cut(sweep(state, cfg, start, s + 2 - start, fixed, alpha=alpha, beta=beta))
        traced.append(traces(swept).withColumn("iter", F.col("iter") + start - 1))
        state, start = swept.drop("z_prev", "trace"), s + 2
        if log.isEnabledFor(logging.INFO):
            last_sweep(traced[-1])
        if aggregate:
            for name, now in (("nw_aggregate", ops.nw(state)), ("nd_aggregate", ops.nd(state))):
                keys = now.columns[:-1]
                model[name] = now if name not in model else _cut(model[name].unionByName(now).groupBy(*keys).agg(F.sum("n").alias("n")))
        if write and out:
            write_tables(tables(state, model), out)
    if traced:
        trace = traced[0]
        for t in traced[1:]:
            trace = trace.unionByName(t)
        model["z_trace"] = trace
    return tables(state, model)


def last_sweep(trace: DataFrame) -> None:
    """Logs how many assignments of each shard the last sweep has changed. The trace has a row a shard and sweep."""
    last = trace.groupBy("shard").agg(F.max_by("changed", "iter").alias("changed"), F.max("iter").alias("iter"))
    for r in sorted(last.collect(), key=lambda r: place(r.shard)):
        log.info("label: %s time: %s iter: %d trace: %d", r.shard, datetime.now(), r.iter, r.changed)


def one_shard(entries: DataFrame) -> DataFrame:
    """All shards as one, in natural order of their labels, null first: documents and entries are numbered on; origin keeps the label."""
    from ..functions import natural_key

    sizes = entries.groupBy("shard").agg((F.max("doc_id") + 1).alias("docs"), (F.max("entry_id") + 1).alias("rows"))
    placed = ops.offsets(sizes, [natural_key(F.col("shard")), F.col("shard")])
    rows = ops.offsets(sizes.select("shard", F.col("rows").alias("docs")), [natural_key(F.col("shard")), F.col("shard")]).select("shard", F.col("offset").alias("ahead"))
    ahead = placed.join(rows, placed["shard"].eqNullSafe(rows["shard"])).select(placed["shard"].alias("_of"), "offset", "ahead")
    joined = entries.join(F.broadcast(ahead), F.col("shard").eqNullSafe(F.col("_of")))
    return joined.select(F.lit("all").alias("shard"), (F.col("entry_id") + F.col("ahead")).alias("entry_id"), (F.col("doc_id") + F.col("offset")).alias("doc_id"), "term_id", "count", F.col("shard").alias("origin"))


def place(label: str | None) -> tuple:
    """Sort key of a shard's label: natural order, null first."""
    return label is not None, natural(label)


def fit_online(entries: DataFrame, terms: DataFrame, cfg: Config, niters: int = 500, omega: float = 1.0, decay_zprior: bool = False) -> dict[str, DataFrame]:
    """Shard after shard in natural order; each starts from the counts of the shards before, weighted by omega to the lag.

    Tables z, nw_hist (t, k, term_id, n: each shard's own counts) and nw (t, ...: decayed sums). The start of z uses
    the counts of earlier shards without decay, or with decay_zprior as the sweeps do.
    """
    labels = sorted((r.shard for r in entries.select("shard").distinct().collect()), key=place)
    done, history = None, None
    for t, label in enumerate(labels):
        state, own, history = online_step(entries.where(F.col("shard").eqNullSafe(F.lit(label))), terms, cfg, t, history, niters, omega, decay_zprior)
        done = state if done is None else done.unionByName(state)
    return {"z": done, "nw_hist": history, "nw": ops.decayed(history, omega)}


def online_step(shard: DataFrame, terms: DataFrame, cfg: Config, t: int, history: DataFrame | None, niters: int, omega: float, decay_zprior: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, own counts, history with them) of one more shard."""
    past = None
    if history is not None:
        past = history.groupBy("k", "term_id").agg(F.sum(F.col("n") * F.pow(F.lit(float(omega)), F.lit(t) - F.col("t"))).alias("n"))
    prior = past if decay_zprior else history
    state = _cut(ops.init_z(shard, ops.zprob(ops.zprior(terms, cfg.topics, cfg.beta, prior)), cfg.seed, *cfg.key).select(*shard.columns, "z"))
    if niters:
        state = _cut(sweep(state, cfg, 1, niters, offset=past).drop("z_prev", "trace"))
    own = ops.nw(state).select(F.lit(t).alias("t"), "k", "term_id", "n")
    return state, own, own if history is None else history.unionByName(own)
