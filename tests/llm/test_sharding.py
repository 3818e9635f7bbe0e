"""Groups of equal texts that fit a shard stay whole."""

import collections

from topicloom.llm import sharding


def test_groups_within_a_quota_are_not_cut(spark):
    rows = [(i, f"copy {i % 5}" if i < 250 else f"text {i}") for i in range(1600)]  # five groups of half a shard
    got = sharding.label_propagation_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of, text = collections.defaultdict(set), dict(rows)
    for r in got:
        of[text[r.doc_id]].add(r.shard)
    assert set(collections.Counter(r.shard for r in got).values()) == {100}
    assert {len(x) for x in of.values()} == {1}
