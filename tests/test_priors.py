"""Sweeps with priors that differ by document, term and topic, against a plain scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom import operators as ops
from topicloom.functions import uniform
from topicloom.operators.sweep import Config, sweep
from topicloom.plans.fit import fit

ENTRY = "shard string, entry_id long, doc_id long, term_id long, count long"


@pytest.mark.parametrize(("topics", "fixed"), [(3, False), (3, True), (20, False)])
def test_vector_priors(spark, topics, fixed):
    rng = np.random.default_rng(6)
    cells = [(d, int(v)) for d in range(8) for v in sorted(rng.choice(9, 5, replace=False))]
    entries = spark.createDataFrame([("p", i, d, v, int(rng.integers(1, 4))) for i, (d, v) in enumerate(cells)], ENTRY)
    a, b = rng.uniform(0.1, 5, (8, topics)), rng.uniform(0.1, 5, (topics, 9))
    alpha = spark.createDataFrame([(d, k, float(a[d, k])) for d in range(8) for k in range(topics)], "doc_id long, k int, a double")
    beta = spark.createDataFrame([(k, v, float(b[k, v])) for k in range(topics) for v in range(9)], "k int, term_id long, b double")
    cfg = Config(topics, 9, vector=True)
    state = ops.init_z_uniform(entries, topics, cfg.seed, *cfg.key)
    rows = state.withColumn("u", uniform(*cfg.key, 1, cfg.seed)).orderBy("entry_id").collect()
    z, nd, nw = [r.z for r in rows], np.zeros((8, topics)), np.zeros((topics, 9))
    for r in rows:
        nd[r.doc_id, r.z] += r["count"]
        nw[r.z, r.term_id] += r["count"]
    for i, r in enumerate(rows):
        d, v, c = r.doc_id, r.term_id, r["count"]
        nd[d, z[i]] -= c
        nw[z[i], v] -= 0 if fixed else c
        p = np.cumsum((nw[:, v] + b[:, v]) / (nw.sum(axis=1) + b.sum(axis=1)) * ((nd[d] + a[d]) / (nd[d].sum() + a[d].sum())))
        z[i] = min(topics - 1, int((p <= r.u * p[-1]).sum()))
        nd[d, z[i]] += c
        nw[z[i], v] += 0 if fixed else c
    nw_fixed = ops.nw(state) if fixed else None
    assert [r.z for r in sweep(state, cfg, fixed=nw_fixed, alpha=alpha, beta=beta).orderBy("entry_id").collect()] == z
    assert [r.z for r in fit(entries, cfg, 1, fixed=nw_fixed, alpha=alpha, beta=beta)["z"].orderBy("entry_id").collect()] == z
    assert [r.z for r in sweep(state, cfg, fixed=nw_fixed).orderBy("entry_id").collect()] != z
