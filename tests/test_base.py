"""Operators on small fixtures, and every registered query against its SQL at the smallest scale."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom import operators as ops
from topicloom.functions import natural_key, shard_label
from topicloom.operators.sweep import Config, sweep, traces
from topicloom.plans import queries as q
from topicloom.plans.fit import fit, fit_online, one_shard, schedule
from topicloom.sources import check, natural, read_dtm
from topicloom.sources.sinks import dense_csv, read_fixed_counts, write_tables

SF = "/root/testdata/sf0.001"
ENTRY = "shard string, entry_id long, doc_id long, term_id long, count long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(spark, shards=2, docs=6, seed=0):
    rng, out = np.random.default_rng(seed), []
    for s in range(shards):
        n = 0
        for d in range(docs):
            for v in sorted(rng.choice(9, 4, replace=False)):
                out.append((f"p{s}", n, d, int(v), int(rng.integers(1, 4))))
                n += 1
    return spark.createDataFrame(out, ENTRY)


def test_dtm_folder(spark, tmp_path):
    for label, body in {"2": "10,0,2\n12,1,1\n", "10": "5,1,3\n5,1,3\n", "1": "0,2,0\n"}.items():
        (tmp_path / f"count_{label}.csv").write_text("doc_id,term_id,count\n" + body)
        (tmp_path / f"doc_{label}.csv").write_text("doc\na\nb\n")
    (tmp_path / "term.csv").write_text("term\nx\ny\nz\n")
    dtm = read_dtm(spark, str(tmp_path))
    assert dtm.dims() == (6, 3) and dtm.shards() == ["1", "2", "10"]
    assert rows(dtm.counts) == [("1", 0, 0, 2, 0), ("10", 0, 0, 1, 3), ("10", 1, 0, 1, 3), ("2", 0, 0, 0, 2), ("2", 1, 2, 1, 1)]
    assert read_dtm(spark, str(tmp_path), parts=["2", "10"]).dims() == (4, 3)
    assert rows(check(dtm.counts, 2)) == [(0, 1, 0)]
    with pytest.raises(ValueError):
        read_dtm(spark, str(tmp_path), "txt")


def test_dtm_parquet(spark, tmp_path):
    import pandas as pd

    for kind, frame in {"count_a": pd.DataFrame({"d": [3, 3, 4], "t": [0, 0, 1], "c": [1, 1, 2]}), "doc_a": pd.DataFrame({"x": [1, 2]}), "term": pd.DataFrame({"t": ["u", "v"]})}.items():
        frame.to_parquet(tmp_path / f"{kind}.pq")
    dtm = read_dtm(spark, str(tmp_path), "pq")
    assert dtm.dims() == (2, 2) and rows(dtm.counts) == [("a", 0, 0, 0, 1), ("a", 1, 0, 0, 1), ("a", 2, 1, 1, 2)]


def test_labels_and_order(spark):
    df = spark.createDataFrame([("x/count_10.pq",), ("count_2.csv",), ("count_b1.csv",)], "f string").select(shard_label(F.col("f")).alias("l"))
    assert [r.l for r in df.orderBy(natural_key(F.col("l"))).collect()] == sorted(["10", "2", "b1"], key=natural) == ["2", "10", "b1"]


def test_schedule():
    assert [s for s, m, _, _ in schedule(5) if m] == [1, 2, 3, 4]
    assert [s for s, m, _, _ in schedule(1) if m] == [0]
    assert [s for s, _, w, _ in schedule(6, 1, 2) if w] == [2, 4, 5]
    assert [s for s, _, _, a in schedule(6, aggregate_last=2) if a] == [4, 5]


def reference_sweep(entries, z, cfg, u, fixed=False):
    """The scan, plainly."""
    k = cfg.topics
    nd, nw, ns = {}, np.zeros((k, cfg.terms)), np.zeros(k)
    for (_, _, d, v, c), t in zip(entries, z):
        nd.setdefault(d, np.zeros(k))[t] += c
        nw[t, v] += c
        ns[t] += c
    out = list(z)
    for i, (_, _, d, v, c) in enumerate(entries):
        nd[d][out[i]] -= c
        if not fixed:
            nw[out[i], v] -= c
            ns[out[i]] -= c
        p = np.cumsum((nw[:, v] + cfg.beta) / (ns + cfg.terms * cfg.beta) * (nd[d] + cfg.alpha) / (nd[d].sum() + k * cfg.alpha))
        out[i] = min(k - 1, int((p <= u[i] * p[-1]).sum()))
        nd[d][out[i]] += c
        if not fixed:
            nw[out[i], v] += c
            ns[out[i]] += c
    return out


@pytest.mark.parametrize("topics", [3, 20])
@pytest.mark.parametrize("fixed", [False, True])
def test_sweep_is_the_scan(spark, topics, fixed):
    from topicloom.functions import uniform

    cfg = Config(topics, 9)
    state = ops.init_z_uniform(corpus(spark, 1), topics, cfg.seed, *cfg.key).withColumn("u", uniform(*cfg.key, 1, cfg.seed))
    got = {r.entry_id: r for r in sweep(state.drop("u"), cfg, fixed=ops.nw(state) if fixed else None).collect()}
    before = sorted(state.collect(), key=lambda r: r.entry_id)
    want = reference_sweep([tuple(r)[:5] for r in before], [r.z for r in before], cfg, [r.u for r in before], fixed)
    assert [got[r.entry_id].z for r in before] == want
    assert [got[r.entry_id].z_prev for r in before] == [r.z for r in before]


def test_invariants(spark):
    cfg = Config(3, 9)
    entries = corpus(spark, 3)
    model = fit(entries, cfg, niters=4, merge_every=2, aggregate_last=2)
    total = entries.agg(F.sum("count")).first()[0]
    for name in ("nd", "nw", "nwsum", "ndsum"):
        assert model[name].agg(F.sum("n")).first()[0] == total
    assert model["nw_aggregate"].agg(F.sum("n")).first()[0] == 2 * total
    assert rows(model["ndsum"]) == rows(ops.ndsum(entries))
    assert model["z"].where("z < 0 or z > 2").isEmpty() and model["z_trace"].count() == 3 * 4


def test_token_unit_equals_entry_unit_for_ones(spark):
    ones = corpus(spark, 2).withColumn("count", F.lit(1).cast("long"))
    state = ops.init_z_uniform(ones, 3, 7, "shard", "doc_id", "term_id")
    one = sweep(state, Config(3, 9)).select("shard", "entry_id", "z")
    two = sweep(ops.tokens(state), Config(3, 9)).select("shard", "entry_id", "z")
    assert rows(one) == rows(two)


def test_zero_counts_and_one_topic(spark):
    entries = spark.createDataFrame([("a", 0, 0, 0, 0), ("a", 1, 0, 1, 2)], ENTRY)
    state = ops.init_z_uniform(entries, 1, 7, "shard", "doc_id", "term_id")
    swept = sweep(state, Config(1, 2))
    assert {r.z for r in swept.collect()} == {0} and rows(traces(swept)) == [("a", 0, 0)]
    assert sweep(state.limit(0), Config(1, 2)).count() == 0


def test_sequential_fit(spark):
    entries = corpus(spark, 2)
    one = one_shard(entries)
    assert one.select("doc_id").distinct().count() == 12 and one.select("entry_id").distinct().count() == one.count()
    assert fit(entries, Config(3, 9), 2, sequential=True)["z_trace"].count() == 2
    with pytest.raises(ValueError):
        fit(entries, Config(3, 9), 1, unit="word")


def test_fixed_counts_stay(spark, tmp_path):
    (tmp_path / "nw.csv").write_text("3.0,1,0\n0,2,5\n")
    nw = read_fixed_counts(spark, str(tmp_path / "nw.csv"))
    assert rows(nw) == [(0, 0, 3), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 2), (1, 2, 5)]
    entries = spark.createDataFrame([("a", 0, 0, 0, 2), ("a", 1, 1, 2, 3)], ENTRY)
    assert rows(fit(entries, Config(2, 3), 3, fixed=nw)["nw"]) == rows(nw)


def test_online(spark):
    entries = corpus(spark, 3)
    terms = spark.range(9).select(F.col("id").alias("term_id"))
    model = fit_online(entries, terms, Config(3, 9), 2, omega=0.5)
    own = {(r.t, r.k, r.term_id): r.n for r in model["nw_hist"].collect()}
    for r in model["nw"].collect():
        assert r.n == pytest.approx(sum(own.get((t, r.k, r.term_id), 0) * 0.5 ** (r.t - t) for t in range(r.t + 1)))
    assert model["z"].count() == entries.count()


def test_merge_is_the_group_by(spark):
    assert rows(q.QUERIES["adlda_merge"](spark, SF)) == rows(ops.nw(q._swept(spark, SF)))


def test_planted_topics(spark):
    rng, out = np.random.default_rng(3), []
    for d in range(45):
        for v in rng.choice(6, 5, replace=False):
            out.append((f"p{d % 3}", len(out), d, int(v) + 6 * (d % 3), 3))
    model = fit(spark.createDataFrame(out, ENTRY), Config(3, 18, 0.1, 0.1), 12)
    top = {r.k: r.n for r in model["nw"].groupBy("k", F.floor(F.col("term_id") / 6).alias("g")).agg(F.sum("n").alias("n")).groupBy("k").agg(F.max("n").alias("n")).collect()}
    assert sum(top.values()) > 0.8 * 45 * 15


def test_sinks(spark, tmp_path):
    nw = spark.createDataFrame([(0, 1, 2), (1, 0, 5)], "k int, term_id long, n long")
    dense_csv(nw, "k", "term_id", "n", 3, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part*")))
    assert np.loadtxt(text.splitlines(), delimiter=",").tolist() == [[0, 2, 0], [5, 0, 0]]
    write_tables({"nw": nw, "z": corpus(spark, 2)}, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/z")).count() == 48


@pytest.mark.parametrize("name", ["dtm_counts", "init_z", "nw_dense", "post_theta", "merge_models", "adlda_pass", "fixed_phi_pass_token", "gibbs_seq_pass", "finagg", "online_nw", "schedule"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = con.execute(q.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    want = sorted(got.fetchall(), key=str)
    assert sorted((tuple(r) for r in q.QUERIES[name](spark, SF).select(*names).collect()), key=str) == want


def test_tables_of_documents_are_deleted_once_the_next_is_written(spark):
    from topicloom.sources.store import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    had = set(os.listdir(folder))
    swept = q.QUERIES["adlda_documents"](spark, SF)
    assert sorted(n.split("-")[0] for n in set(os.listdir(folder)) - had) == ["state", "terms"]
    assert swept.count() == q.Corpus(spark, SF).entries.count()


def test_a_sweep_is_the_same_in_small_chunks(spark, monkeypatch):
    import topicloom.operators.sweep as module

    state = ops.init_z_uniform(corpus(spark, 3).withColumn("shard", F.when(F.col("shard") != "p0", F.col("shard"))), 4, 7, "shard", "doc_id", "term_id")
    whole = rows(sweep(state, Config(4, 9), 1, 2).select(F.coalesce("shard", F.lit("")), "entry_id", "z_prev", "z", "trace"))
    monkeypatch.setattr(module, "CHUNK", 5)
    assert whole == rows(sweep(state, Config(4, 9), 1, 2).select(F.coalesce("shard", F.lit("")), "entry_id", "z_prev", "z", "trace")) and len(whole) == 72
