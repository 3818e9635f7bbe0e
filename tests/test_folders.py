"""A fit from folder to folder, and batches of a stream that repeat or come late."""

import logging
import os

import numpy as np
import pandas as pd
import pytest

from topicloom.operators.sweep import Config
from topicloom.plans.folders import fit_folder
from topicloom.streaming import known, start_online

ENTRY = "shard string, entry_id long, doc_id long, term_id long, count long"


def folder(path, ftype):
    """Shards 2 and 10: five documents, the fourth without entries, nine terms."""
    rng, rows = np.random.default_rng(3), {}
    for label in ("10", "2"):
        cells = [(d, v, int(rng.integers(1, 5))) for d in (0, 1, 2, 4) for v in sorted(rng.choice(9, 4, replace=False))]
        rows[label] = pd.DataFrame(cells, columns=["doc_id", "term_id", "count"]).astype("int32")
        write = lambda df, name: df.to_csv(f"{path}/{name}.csv", index=False) if ftype == "csv" else df.to_parquet(f"{path}/{name}.pq")
        write(rows[label], f"count_{label}")
        write(pd.DataFrame({"d": range(5)}), f"doc_{label}")
    write(pd.DataFrame({"t": range(9)}), "term")
    return rows


def lines(path):
    names = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return np.array([[float(x) for x in line.split(",")] for f in names for line in open(f"{path}/{f}")])


@pytest.mark.parametrize("ftype,kind", [("csv", "distributed"), ("pq", "online"), ("pq", "sequential")])
def test_folder_to_folder(spark, tmp_path, ftype, kind):
    rows = folder(tmp_path, ftype)
    out, said = str(tmp_path / "out"), str(tmp_path / "said.txt")
    model = fit_folder(spark, str(tmp_path), out, 3, kind, niters=2, aggregate_last=2, omega=0.5, ftype=ftype, log_file=said)
    z, now = {}, np.zeros((3, 9))
    for r in model["z"].orderBy("shard", "entry_id").collect():
        z.setdefault(r.shard, []).append(r.z)
    for label, own in z.items():
        assert lines(f"{out}/z/shard={label}").ravel().tolist() == own
    for label in sorted(rows, key=int):
        df = rows[label]
        if kind == "sequential":
            continue
        nd = np.zeros((5, 3))
        np.add.at(nd, (df["doc_id"], z[label]), df["count"])
        assert (lines(f"{out}/nd/shard={label}") == nd).all()
        own = np.zeros((3, 9))
        np.add.at(own, (z[label], df["term_id"]), df["count"])
        now = now * (0.5 if kind == "online" else 1) + own
        if kind == "online":
            assert np.allclose(lines(f"{out}/nw/shard={label}"), now)
    if kind != "online":
        assert lines(f"{out}/nw").sum() == sum(df["count"].sum() for df in rows.values())
        assert lines(f"{out}/nwfinagg").sum() == 2 * lines(f"{out}/nw").sum()
        assert kind == "sequential" or (lines(f"{out}/nw") == now).all()
        told = open(said).read().splitlines()
        assert told and all(x.startswith("label: ") and " trace: " in x for x in told)
        assert len(lines(f"{out}/z_trace/shard={'all' if kind == 'sequential' else 10}")) == 2


def test_late_and_repeated_batches(spark, tmp_path, caplog):
    path, cfg = str(tmp_path), Config(2, 9)
    terms = spark.range(9).selectExpr("cast(id as int) term_id")

    def arrive(*labels, n=1):
        rows = [(label, i, 0, i, n) for label in labels for i in range(3)]
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(f"{path}/in")
        start_online(spark.readStream.schema(ENTRY).parquet(f"{path}/in"), terms, cfg, f"{path}/out", f"{path}/state").awaitTermination()

    os.makedirs(f"{path}/in")
    arrive("2")
    with caplog.at_level(logging.WARNING, "topicloom"):
        arrive("1", "02", "3")  # "1" is late; "02" has the place of "2", which is no reason to drop it
    assert [(t, label) for t, label, _ in known(spark, f"{path}/out")] == [(0, "2"), (1, "02"), (2, "3")]
    assert "1 shards came too late: 1" in caplog.text
    assert spark.read.parquet(f"{path}/out/late").where("shard = 1").count() == 3
    with pytest.raises(Exception, match="came in batch"):
        arrive("3", n=7)
    assert spark.read.parquet(f"{path}/out/nw_hist").where("t = 2").selectExpr("sum(n)").first()[0] == 3
