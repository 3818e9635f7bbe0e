"""The online fit, streamed and at once, against a plain scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import uniform
from topicloom.operators.sweep import Config
from topicloom.plans import queries as q
from topicloom.plans.fit import fit, fit_online, one_shard
from topicloom.sources import natural
from topicloom.streaming import history_of, start_online

SF = "/root/testdata/sf0.001"
ENTRY = "shard string, entry_id long, doc_id long, term_id long, count long"


def corpus(spark, labels):
    rng = np.random.default_rng(4)
    rows = []
    for label in labels:
        cells = [(d, int(v)) for d in range(6) for v in sorted(rng.choice(9, 4, replace=False))]
        rows += [(label, n, d, v, int(rng.integers(1, 4))) for n, (d, v) in enumerate(cells)]
    return spark.createDataFrame(rows, ENTRY)


def plain(entries, cfg, sweeps, omega):
    """{(t, k, term_id): n} by a loop over entries."""
    k, drawn = cfg.topics, entries
    for s in range(sweeps + 1):
        drawn = drawn.withColumn(f"u{s}", uniform(*cfg.key, s, cfg.seed))
    shards, history = {}, []
    for r in drawn.collect():
        shards.setdefault(r.shard, []).append(r)
    order = sorted(shards, key=lambda x: (x is not None, natural(x)))
    for t, label in enumerate(order):
        rows = sorted(shards[label], key=lambda r: r.entry_id)
        prior = cfg.beta + sum(history, np.zeros((k, cfg.terms)))
        past = sum((omega ** (t - s) * h for s, h in enumerate(history)), np.zeros((k, cfg.terms)))
        own, nd, z = np.zeros((k, cfg.terms)), {}, []
        for r in rows:
            p = np.cumsum(prior[:, r.term_id] / prior[:, r.term_id].sum())
            z.append(min(k - 1, int((p <= r.u0).sum())))
            own[z[-1], r.term_id] += r["count"]
            nd.setdefault(r.doc_id, np.zeros(k))[z[-1]] += r["count"]
        for s in range(1, sweeps + 1):
            for i, r in enumerate(rows):
                c, d = r["count"], nd[r.doc_id]
                own[z[i], r.term_id] -= c
                d[z[i]] -= c
                now = own + past
                p = np.cumsum((now[:, r.term_id] + cfg.beta) / (now.sum(axis=1) + cfg.terms * cfg.beta) * (d + cfg.alpha) / (d.sum() + k * cfg.alpha))
                z[i] = min(k - 1, int((p <= r[f"u{s}"] * p[-1]).sum()))
                own[z[i], r.term_id] += c
                d[z[i]] += c
        history.append(own)
    return {(t, int(j), int(v)): h[j, v] for t, h in enumerate(history) for j, v in zip(*np.nonzero(h))}


def counts(df):
    return {(r.t, r.k, r.term_id): r.n for r in df.collect() if r.n}


def streamed(spark, entries, terms, cfg, niters, omega, path):
    entries.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(entries.schema).parquet(f"{path}/in")
    start_online(stream, terms, cfg, f"{path}/out", f"{path}/state", niters=niters, omega=omega).awaitTermination()
    return history_of(spark, f"{path}/out")


@pytest.mark.parametrize("omega", [0.5, 1.0])
def test_online_fits_are_the_scan(spark, tmp_path, omega):
    cfg, entries = Config(3, 9), corpus(spark, ["w10", "w2", "w9"])
    terms = spark.range(9).select(F.col("id").alias("term_id"))
    want = plain(entries, cfg, 2, omega)
    assert counts(fit_online(entries, terms, cfg, 2, omega=omega)["nw_hist"]) == want
    assert counts(streamed(spark, entries, terms, cfg, 2, omega, tmp_path)) == want


def test_registered_online_fit_is_the_scan(spark):
    weeks = q.Corpus(spark, SF, "weeks")
    want = plain(weeks.entries, Config(q.K, weeks.size, q.ALPHA, q.BETA, seed=q.SEED), 2, q.OMEGA)
    got = counts(q.QUERIES["online_fit"](spark, SF))
    assert got == want and len({t for t, _, _ in got}) > 1


def test_null_labels_are_a_shard(spark, tmp_path):
    cfg, entries = Config(3, 9), corpus(spark, ["w10", None, "w2"])
    terms = spark.range(9).select(F.col("id").alias("term_id"))
    one = one_shard(entries)
    assert one.count() == entries.count() and one.select("entry_id").distinct().count() == entries.count()
    assert [r.origin for r in one.groupBy("origin").agg(F.min("doc_id").alias("d")).orderBy("d").collect()] == [None, "w2", "w10"]
    assert fit(entries, cfg, 1, sequential=True)["z"].count() == entries.count()
    want = plain(entries, cfg, 1, 0.5)
    assert counts(fit_online(entries, terms, cfg, 1, omega=0.5)["nw_hist"]) == want
    assert counts(streamed(spark, entries, terms, cfg, 1, 0.5, tmp_path)) == want
