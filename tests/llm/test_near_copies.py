"""Links where ids are null or stand on several texts."""

import collections

import numpy as np

from topicloom.llm import ngram_join


def said(tag, first=0, n=100):
    return " ".join(f"{tag}{k}" for k in range(first, first + n))


def test_one_id_on_two_sets_keeps_the_links_of_both(spark):
    texts = [(5, said("a")), (5, said("b")), (7, said("b")), (9, said("b", 1)), (8, said("a")), (10, said("a", 1)), (11, said("c"))]
    got = ngram_join.join(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 5), (10, 5), (11, 11)]
    got = ngram_join.linked(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(collections.Counter(r.root for r in got).values()) == [1, 3, 3]


def test_null_ids_link(spark):
    chain = [(3, said("a")), (None, said("a", 6)), (9, said("a", 12))]
    others = [(None, said("b")), (None, said("b", 1)), (None, said("c")), (None, ""), (4, None)]
    got = ngram_join.join(spark.createDataFrame(chain + others, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == {(3, 3): 1, (None, 3): 1, (9, 3): 1, (None, None): 4, (4, 4): 1}


def test_survivors_are_those_of_brute_force():
    """Clipped counts bound nothing; blocks; the best of each member, and whether there were more."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(150, 190, 70)
    points = [ngram_join.point(np.unique(rng.integers(0, 1 << 16, 3 * n, dtype=np.uint64))[:n]) for n in sizes]
    points += [np.minimum(p.astype(int) + 250 * (rng.random(len(p)) < 0.02), 255).astype(np.uint8) for p in points[:9]] + points[:20]
    sizes = np.concatenate([sizes, sizes[:9], sizes[:20]])
    ids, comps, held = rng.permutation(len(sizes)), rng.integers(0, 9, len(sizes)), ngram_join.aligned(points)
    for side in (np.full(len(sizes), 2), rng.integers(0, 2, len(sizes))):
        want = {}
        for i in range(len(ids)):
            for j in range(len(ids)):
                bound = np.minimum(held[i], held[j]).sum()
                if ids[i] < ids[j] and comps[i] != comps[j] and (side[i] == 2 or side[i] != side[j]) and bound >= ngram_join.enough(sizes[i], sizes[j], 85):
                    want[ids[i], ids[j]] = bound
        a, b, more = ngram_join.survivors(ids, comps, held, sizes, side, 85, 1000)
        assert want and not more and set(zip(a.tolist(), b.tolist())) == set(want)
        a, b, more = ngram_join.survivors(ids, comps, held, sizes, side, 85, 1)
        assert set(zip(a.tolist(), b.tolist())) <= set(want) and len(a) <= len(ids) and more


def test_rounds_find_all_links(spark, monkeypatch):
    """Families whose members link to few others: with one candidate a member and small trees the components stay."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(4):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(40):
            copy = list(base)
            for k in rng.integers(0, 60, rng.integers(0, 3)):
                copy[k] = str(rng.choice(vocabulary))
            texts.append(copy)
    shingled = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(shingled):
        for j in range(i):
            if 100 * len(x & shingled[j]) >= 85 * len(x | shingled[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BEST", 1)
    monkeypatch.setattr(ngram_join, "TREE", 8)
    assert [r.component_id for r in ngram_join.join(df).orderBy("doc_id").collect()] == root and len(set(root)) > 4


def test_a_pair_that_was_tried_is_not_found_again():
    """It takes no member's place either; ids that are not there change nothing."""
    point = ngram_join.point(np.arange(90, dtype=np.uint64))
    ids, comps, sizes = np.array([7, 3, 5]), np.arange(3), np.full(3, 90)
    points, side = ngram_join.aligned([point] * 3), np.full(3, 2)
    tried = np.array([0, 0, 1]), np.array([3, 99, 5])  # 7 with 3, 3 with 5
    a, b, more = ngram_join.survivors(ids, comps, points, sizes, side, 85, 1, tried)
    assert set(zip(a.tolist(), b.tolist())) == {(5, 7)} and not more


def test_sets_that_link_share_a_key():
    """Whatever is left out: sets that differ as much as a link allows, small, clipped and clustered ones too."""
    rng = np.random.default_rng(8)
    pairs = shared = 0
    for threshold in (80, 85):
        for n in [*range(1, 60), 150, 400, 1500] * 3:
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for gone in range(n):  # as many go as come, or none comes
                for come in {0, gone}:
                    if 100 * (n - gone) >= threshold * (n + come):
                        last = gone, come
            other = np.concatenate([rng.permutation(base)[last[0] :], rng.integers(0, 1 << 63, last[1], dtype=np.uint64)])
            sets = [np.sort(base), np.sort(other)]
            sizes = np.array([len(x) for x in sets])
            who, key = ngram_join.keys(np.repeat([0, 1], sizes), np.concatenate(sets), sizes, threshold)
            pairs, shared = pairs + 1, shared + bool(set(key[who == 0]) & set(key[who == 1]))
    assert pairs == shared > 300


def test_unrelated_sets_hardly_meet():
    """Groups without shingles, which many sets of one size have, bring few of them under a key."""
    rng = np.random.default_rng(9)
    sets = [np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(2000)]
    sizes = np.array([len(x) for x in sets])
    _, key = ngram_join.keys(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), sizes, 80)
    count = np.unique(key, return_counts=True)[1]
    assert count[count > 1].sum() < 0.002 * len(key)


def test_texts_that_no_one_asks_for_stay_where_they_are(spark):
    df = spark.range(3000).selectExpr("id", "xxhash64(id) as text_hash")
    asked = df.where("id % 60 = 7")
    got = {r.id for r in ngram_join._maybe(df, asked).collect()}
    assert set(range(7, 3000, 60)) <= got and len(got) < 500
    assert not ngram_join._maybe(df, asked.limit(0)).collect()
