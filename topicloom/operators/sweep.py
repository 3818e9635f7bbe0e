"""The Gibbs sweep: the one step that goes entry by entry, in Arrow batches sorted by shard or document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import uniform
from . import nw as count_nw

#: Entries of a shard that are plain Python numbers at once.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Config:
    """unit: entry (a draw for all tokens of a term in a document) or token. vector: the form of the conditional that
    the reference has for vector priors; it rounds differently. Priors that differ are tables given to sweep."""

    topics: int
    terms: int
    alpha: float = 1.0
    beta: float = 1.0
    vector: bool = False
    seed: int = 7
    key: tuple[str, ...] = ("shard", "doc_id", "term_id")


class Scan:
    """State of a scan: counts by document, and by term of what it has met. Up to 16 topics plain lists are faster.
    beta_sums: by topic, of a vector prior over all terms."""

    def __init__(self, cfg: Config, totals: list[float], fixed: bool, beta_sums: list[float] | None = None):
        self.cfg, self.fixed = cfg, fixed
        self.ns, self.nw = list(totals), {}
        self.a, self.b = [cfg.alpha] * cfg.topics, [cfg.beta] * cfg.topics
        self.ka, self.vb = cfg.topics * cfg.alpha, beta_sums or [cfg.terms * cfg.beta] * cfg.topics

    def step(self, v: int, c: int, z: int, u: float, nd: list, total: float, alpha: list | None = None, beta: list | None = None) -> int:
        """The new topic of an entry of term v and c tokens; changes nd in place. total: tokens of the document less c.
        alpha of the document and beta of the term, by topic, replace the constants."""
        a, b, vb = alpha or self.a, beta or self.b, self.vb
        ka = sum(alpha) if alpha else self.ka
        w, ns = self.nw[v], self.ns
        nd[z] -= c
        if not self.fixed:
            w[z] -= c
            ns[z] -= c
        k = self.cfg.topics
        if k <= 16:
            cum, p = [], 0.0
            for i in range(k):
                x = ((w[i] + b[i]) / (ns[i] + vb[i])) * ((nd[i] + a[i]) / (total + ka)) if self.cfg.vector else (w[i] + b[i]) / (ns[i] + vb[i]) * (nd[i] + a[i]) / (total + ka)
                p = x + p
                cum.append(p)
            bar, new = u * p, 0
            while new < k - 1 and cum[new] <= bar:
                new += 1
        else:
            w_, s_, d_, a, b, vb = (np.array(x, float) for x in (w, ns, nd, a, b, vb))
            x = (w_ + b) / (s_ + vb) * ((d_ + a) / (total + ka)) if self.cfg.vector else (w_ + b) / (s_ + vb) * (d_ + a) / (total + ka)
            cum = np.cumsum(x)
            new = min(k - 1, int(np.searchsorted(cum, u * cum[-1], side="right")))
        nd[new] += c
        if not self.fixed:
            w[new] += c
            ns[new] += c
        return new


def sweep(entries: DataFrame, cfg: Config, first: int = 1, sweeps: int = 1, fixed: DataFrame | None = None, offset: DataFrame | None = None, alpha: DataFrame | None = None, beta: DataFrame | None = None) -> DataFrame:
    """entries with z after sweeps first, first + 1, ...; z_prev, z before the last one; trace, array of changes per sweep.

    Each shard is one scan in order of entry_id and starts from the counts of all shards; with fixed (k, term_id, n) these
    never change, and each document is a scan of its own. offset (k, term_id, n) adds decayed counts of earlier shards.
    alpha (doc_id, k, a) and beta (k, term_id, b) replace the constants; they have all topics of each document and term.
    A shard gets the counts of its own terms once, in rows ahead of its entries, so no table of all topics and terms is
    sent to any task; with fixed, alpha or beta each row carries those of its term. trace marks, for each sweep, whether
    the entry changed. A task holds a shard as plain arrays and goes over it CHUNK entries at a time.
    """
    base = fixed if fixed is not None else count_nw(entries)
    if offset is not None:
        base = base.unionByName(offset).groupBy("k", "term_id").agg(F.sum("n").alias("n"))
    sums = {r.k: r.n for r in base.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    totals = [float(sums.get(k, 0)) for k in range(cfg.topics)]
    slots = F.transform(F.sequence(F.lit(0), F.lit(cfg.topics - 1)), lambda k: F.coalesce(F.element_at("m", k.cast("int")), F.lit(0.0)))
    packed = base.groupBy("term_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), F.col("n").cast("double")))).alias("m")).select("term_id", slots.alias("_w"))
    beta_sums, more = None, []
    if beta is not None:
        sums_b = {r.k: r.b for r in beta.groupBy("k").agg(F.sum("b").alias("b")).collect()}
        beta_sums = [float(sums_b[k]) for k in range(cfg.topics)]
    draws = F.array(*(uniform(*cfg.key, s, cfg.seed) for s in range(first, first + sweeps)))
    ahead = fixed is None and alpha is None and beta is None
    zeros = F.array_repeat(F.lit(0.0), cfg.topics)
    if ahead:
        own_terms = entries.select("shard", "term_id").distinct().join(packed, "term_id", "left").withColumn("_w", F.coalesce("_w", zeros))
        rows = entries.unionByName(own_terms, allowMissingColumns=True)
    else:
        rows = entries.join(packed, "term_id", "left").withColumn("_w", F.coalesce("_w", zeros))
    for prior, of, value, name in ((alpha, "doc_id", "a", "_a"), (beta, "term_id", "b", "_b")):
        if prior is not None:
            by_topic = F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), F.col(value).cast("double"))))
            array = F.transform(F.sequence(F.lit(0), F.lit(cfg.topics - 1)), lambda k: F.element_at("m", k.cast("int")))
            rows = rows.join(prior.groupBy(of).agg(by_topic.alias("m")).select(of, array.alias(name)), of, "left")
            more.append(name)
    keys = ["shard", "doc_id"] if fixed is not None else ["shard"]
    n = entries.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(n), *keys).sortWithinPartitions(*keys, *([F.col("_w").isNull()] if ahead else []), "entry_id")
    rows = rows.withColumn("_u", draws)  # here, as numbers drawn take more room in a shuffle than an entry
    keep = [f for f in entries.schema.fields if f.name != "z"]
    schema = T.StructType([*keep, T.StructField("z_prev", T.IntegerType()), T.StructField("z", T.IntegerType()), T.StructField("trace", T.ArrayType(T.IntegerType()))])
    names, frozen = [f.name for f in keep], fixed is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of = None

        def solve() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if ahead:
                mine = t.column("_w").is_valid()
                own_w, t = t.filter(mine), t.filter(pc.invert(mine)).drop_columns("_w")
                terms = pc.index_in(t.column("term_id"), value_set=own_w.column("term_id").combine_chunks())
                w = own_w.column("_w").to_pylist()
            else:
                terms = t.column("term_id").combine_chunks().dictionary_encode().indices
                w = t.column("_w").combine_chunks().take(pa.array(np.unique(terms.to_numpy(), return_index=True)[1])).to_pylist()
            if any(t.column(name).null_count or pc.any(pc.is_null(pc.list_flatten(t.column(name)))).as_py() for name in more):
                raise ValueError("alpha or beta lacks a document, a term or a topic")
            docs = t.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            terms, counts, zs = terms.to_numpy(), t.column("count").to_numpy(), t.column("z").to_numpy().astype(np.int32)
            us = t.column("_u").combine_chunks().flatten().to_numpy().reshape(-1, sweeps)
            scan = Scan(cfg, totals, frozen, beta_sums)
            scan.nw = w
            nd = np.zeros((docs.max(initial=-1) + 1, cfg.topics), np.int64)
            np.add.at(nd, (docs, zs), counts)
            size, nd = nd.sum(axis=1).tolist(), nd.tolist()
            before, trace = zs, np.zeros((len(zs), sweeps), np.int32)
            for s in range(sweeps):
                before, zs = zs, np.empty_like(zs)
                for i in range(0, len(zs), CHUNK):
                    j = min(len(zs), i + CHUNK)
                    a, b = (t.column(name).slice(i, j - i).to_pylist() if name in more else [None] * (j - i) for name in ("_a", "_b"))
                    part = zip(*(x[i:j].tolist() for x in (docs, terms, counts, before, us[:, s])), a, b)
                    zs[i:j] = [scan.step(v, c, z, u, nd[d], size[d] - c, x, y) for d, v, c, z, u, x, y in part]
                trace[:, s] = zs != before
            for i in range(0, len(zs), CHUNK):
                some = t.slice(i, CHUNK)
                marks = trace[i : i + CHUNK]
                changed = pa.ListArray.from_arrays(pa.array(np.arange(0, marks.size + 1, sweeps, dtype=np.int32)), pa.array(marks.reshape(-1)))
                cols = [some.column(c).combine_chunks() for c in names] + [pa.array(before[i : i + CHUNK]), pa.array(zs[i : i + CHUNK]), changed]
                yield pa.RecordBatch.from_arrays(cols, names=names + ["z_prev", "z", "trace"])

        for batch in batches:
            key = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            cuts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]] + [len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if key[a] != of and held:
                    yield from solve()
                of = key[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve()

    return rows.select(*names, "z", "_w", "_u", *more).mapInArrow(run, schema)


def traces(swept: DataFrame) -> DataFrame:
    """(shard, iter, changed): entries whose topic changed, per shard and sweep."""
    rows = swept.select("shard", F.posexplode("trace").alias("iter", "x"))
    return rows.groupBy("shard", "iter").agg(F.sum("x").cast("long").alias("changed"))
