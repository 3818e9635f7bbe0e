"""Stages of the pipeline on tables that are empty, or have nulls, repeated ids and rows, and clashing names."""

import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm import common


def said(tag, first=0, n=100):
    return " ".join(f"{tag}{k}" for k in range(first, first + n))


def test_pipeline_keeps_one_of_each_component(spark):
    near = [(None, said("n")), (None, said("n")), (None, said("n", 1)), (None, said("m")), (None, said("k"))]
    ids = [(4, said("a")), (4, said("b")), (4, said("a")), (6, said("a", 1)), (None, said("b", 1)), (2, ""), (2, ""), (None, ""), (3, said("f")), (3, said("f", 1))]
    for parts in (1, 3):
        df = spark.createDataFrame(near + ids, "doc_id long, text string").repartition(parts).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
        got = corpus_pipeline.near_copies(spark, df, "").collect()
        assert tuple(got[0].asDict()) == corpus_pipeline.COLUMNS
        held = collections.Counter((r.doc_id, r.text) for r in got)
        assert sum(held.pop((None, said("n", k)), 0) for k in (0, 1)) == 1
        assert sum(held.pop((3, said("f", k)), 0) for k in (0, 1)) == 1
        assert held == {(None, said("m")): 1, (None, said("k")): 1, (4, said("a")): 1, (4, said("b")): 1, (2, ""): 1, (None, ""): 1}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _shard int, score double, _h long"


def run_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        docs = common.table(stage(spark, docs, ""), f"test-{name}")
        if name != "bins":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    return docs


def test_stages_on_an_empty_table(spark):
    assert run_stages(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_stages_on_nulls_repeated_rows_and_clashing_columns(spark):
    """Equal texts leave one document, others stay; what the mixture takes comes out of the bins, word for word."""
    rng = np.random.default_rng(1)
    words = {lang: [f"{c}{a}{b}" for c in "bdfg" for a in "aeiou" for b in tail] for lang, tail in (("en", ("ing", "the", "er")), ("de", ("ung", "sch", "ße")))}
    say = lambda lang: " ".join(rng.choice(words[lang], int(rng.integers(30, 80))))
    rows = [(i, say(lang), lang, ("s1", "s2", None)[i % 3], None, 1, 0.5, 3) for i in range(60) for lang in (("en", "de")[i % 2],)]
    rows += [rows[0], rows[0], (None, say("en"), None, None, None, 1, 0.5, 3), (None, rows[1][1], "de", "s9", 7, 1, 0.5, 3), (70, None, "en", "s1", None, 1, 0.5, 3), (71, "", "en", "s1", 0, 1, 0.5, 3), (72, " 12 ?", None, "s1", 5, 1, 0.5, 3)]
    got = run_stages(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    size = {}
    for r in got:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.n_words
    told = {r[0]: len(r[1].split()) for r in reversed(rows) if r[1]}  # of the null ids the first; the other repeats a text
    assert set(size) <= set(range(60)) | {None} and not {70, 71, 72} & set(size)
    assert all(size[d] in (told[d], 2 * told[d]) for d in size)
    total = sum(told[i] for i in range(60))
    assert 1.3 * total < sum(size.values()) < 1.7 * (total + told[None])
