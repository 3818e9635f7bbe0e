"""The operators against brute force on a small messy corpus, and on empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import fingerprint, html_text, langid, mixing, nearest, ngram_join, packing, queries, sharding, suffix_dedup, tokenfile

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, c long, n long, bucket int, _uid string, size long"


def corpus():
    rng = np.random.default_rng(5)
    vocabulary = {k: [f"{k}{'aeiou'[i % 5]}{i * 7 % 97}" if k == "en" else f"{'zäöß'[i % 4]}{k}{i}" for i in range(300)] for k in ("en", "de")}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    common = say("en", 60)
    texts = []
    for i in range(30):
        lang = ("en", "de")[i % 2]
        text = say(lang, int(rng.integers(3, 120)))
        if i % 5 == 0:
            text += f" {common} " + say(lang, 20)
        texts.append((text, lang))
    texts += [texts[1], texts[2], texts[2]]  # copies
    words = texts[3][0].split() * 2
    texts += [(" ".join(words), "de"), (" ".join(words[:-1]) + " other", "de"), (" ".join(["x"] + words), "de")]  # near copies
    texts += [("", "en"), (None, "en"), ("?? 12 !!", None), ("A", "en"), ("ab ab " * 400, "en"), (say("en", 4000), "en"), ("Tab\tline\n\nend  two ", None)]
    rows = [(i, t, lang, ("s1", "s10", "s2", None)[i % 4] if i % 3 else "s1", None, 1, 2, 3, 4, "x", 9) for i, (t, lang) in enumerate(texts)]
    return rows + [rows[7]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_file(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    rows = corpus()
    rows += [(200 + i, t, *rows[0][2:]) for i, t in enumerate(ODD)] + [(None, "no id", *rows[0][2:]), (None, "a " * 70_000 + "b", *rows[0][2:])]
    records = tokenfile.write(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    found = sorted((tuple(r)[:4] for r in tokenfile.documents(records).collect()), key=lambda r: r[1])
    start, want = 0, []
    nulls = {r[2]: r for r in found if r[0] is None}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        if r[0] is None:  # by the hash of their text
            assert nulls[len(ids)][3] == zlib.crc32(ids.tobytes())
            want.append(found[len(want)])
        else:
            want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert len(nulls) == 2 and found == want
    assert tokenfile.documents(tokenfile.write(empty, path)).count() == 0


ODD = ["a  b", "a \n b", "a\n\nb\n", "\na", "a<|endoftext|>b c", "<|endoftext|>", "\u3000a \u00a0b", "x" * 300 + " y", "it's 'x  's\t1", "\r\n\r\n", " 5 55", "  ", "\x1c \x85"]


@pytest.mark.parametrize("pieces", [tokenfile.PIECES, 50])
def test_encoder_is_the_plain_call(monkeypatch, pieces):
    """White space of all kinds, added tokens, long words; also when pieces must be forgotten."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "PIECES", pieces)
    path, rng = public_tokenizers.path(queries.TOKENIZER), np.random.default_rng(0)
    encoder, tokenizer = tokenfile.Encoder(path), Tokenizer.from_file(path)
    marks = ["a", "b", " ", " c", "\n", "\t", "'s", "\u00e9", "\u00a0", "1", "\u2003", "!", "\u3000", "\r", "<|endoftext|>"]
    for texts in [ODD, [""], *(["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(30)] for _ in range(60))]:
        ids, sizes = encoder.encode(pa.array(texts))
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_repair_ends_and_comes_back():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([2], np.uint32), np.full(999, 7, np.uint32), rng.integers(0, 9, 5000).astype(np.uint32), np.tile(rng.integers(3, 99, 50), 9).astype(np.uint32)):
        row = tokenfile.compressed(ids, 100)
        shard = tokenfile.Shard(row)
        assert (shard.ids() == ids).all() and len(shard.symbols) <= len(ids)
        pairs, last = {}, None  # no pair is left that occurs twice, without overlap
        for i, p in enumerate(zip(shard.symbols.tolist(), shard.symbols[1:].tolist())):
            if 2 not in p and (p != last):
                pairs[p] = pairs.get(p, 0) + 1
                last = p
            else:
                last = None
        assert max(pairs.values(), default=0) <= 1
        for a, b in ((0, 1), (3, 50), (len(ids) - 5, len(ids))):
            if 0 <= a < b <= len(ids):
                assert (shard.ids(a, b) == ids[a:b]).all()


def test_language(docs, empty):
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert 0 <= r.score <= 1
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert r.lang_pred == "und"
    told = [r for r in got if r.lang and r.text and len(r.text) > 40]
    assert sum(r.lang == r.lang_pred for r in told) >= 0.9 * len(told)
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_gradients():
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 123, (12, 6)), np.array([0, 1, 0, 1, 0, 1])
    x[:, y == 1] -= 32
    model = langid.BiGru(["a", "b"])
    loss = lambda: -np.log(model.probabilities(x)[:, y, np.arange(6)]).mean()
    before = loss()
    model.fit(x, y, epochs=40)
    assert loss() < 0.2 * before


def test_fingerprints(docs, empty, spark):
    rows = sorted((r for r in {(r[0], r[1] or "") for r in corpus()}), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs.dropDuplicates(["doc_id"])).collect()}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.fingerprint(text.encode()))
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(following.encode()))
    assert fingerprint.fingerprints(docs).count() == len(corpus())
    assert fingerprint.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(None, "ab")], "doc_id long, text string")
    assert fingerprint.fingerprints(one).first().near_next == 1.0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        assert fingerprint.distance(a, b) == plain(a, b)


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=64, per_group=16).collect()
    by_id = {r[0]: r for r in corpus()}
    bins, words = collections.defaultdict(list), collections.Counter()
    for r in rows:
        bins[r.group, r.bin].append(r)
        words[r.doc_id] += r.n_words
    for held in bins.values():
        assert sum(r.n_words for r in held) <= 64
        assert len({by_id[r.doc_id][3] for r in held}) == len(held) == len({by_id[r.doc_id][1] or "" for r in held})
        at = 0
        for r in sorted(held, key=lambda r: (r.offset, r.n_words)):
            assert r.offset == at
            at += r.n_words
    assert words == {i: len(WORD.findall(r[1] or "")) * sum(x[0] == i for x in corpus()) for i, r in by_id.items()}
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    assert [b for b, _ in packing.best_fit([(6, 1, None), (5, 2, None), (4, 2, None), (3, 3, None)], 10)] == [0, 1, 0, 1]
    assert len({b for b, _ in packing.best_fit([(1, k, 5) for k in range(7)], 10)}) == 7


def test_blocks_follow_the_tree(spark):
    """Each source's blocks per shard are the tree's, shards are even in blocks, whole and partly taken sources alike."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ("a", "b", "c", "d", None)[int(i % 10 > 4) * (i % 5)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    blocks, drawn, held = {}, mixing.draw, []
    mixing.draw = lambda b, shards, seed: held.append((b, shards, seed)) or drawn(b, shards, seed)
    try:
        got = mixing.mix(df).collect()
    finally:
        mixing.draw = drawn
    (quotas, shards, seed), = held
    tree = mixing.splitting_tree([len(b) for b in quotas], shards, seed)
    places = drawn(quotas, shards, seed)
    for i, own in enumerate(places):
        assert sorted(own) == sorted(quotas[i]) and np.bincount(list(own.values()), minlength=shards).tolist() == tree[:, i].tolist()
    assert np.ptp(tree.sum(axis=1)) <= 4
    words = collections.Counter()
    for r in got:
        for c in r._copies:
            words[c.shard] += r._size
    assert len(words) == 16 and max(words.values()) < 1.3 * min(words.values())
    files = mixing.in_shards(mixing.mix(df), ["doc_id"])
    assert files.count() == sum(len(r._copies) for r in got)
    per_file = {}
    for r in files.withColumn("p", F.spark_partition_id()).collect():
        per_file.setdefault(r.p, []).append(r.doc_id)
    by_order = {}
    for r in got:
        for c in r._copies:
            by_order.setdefault(c.shard, []).append((c.order, r.doc_id))
    parts = max(per_file) // 16 + 1 if max(per_file) >= 16 else 1
    for shard, rows in by_order.items():
        told = [d for p in range(shard * parts, (shard + 1) * parts) for d in per_file.get(p, [])]
        assert told == [d for _, d in sorted(rows)]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(corpus())
    size, source = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}, {r[0]: r[3] for r in corpus()}
    taken, target = collections.Counter(), {}
    for r in got:
        assert r._size == size[r.doc_id] and r._taken == len(r._copies) * r._size <= 2 * r._size
        taken[source[r.doc_id]] += r._taken
        target[source[r.doc_id]] = r._target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size[r[0]] for r in corpus()))
    for s in target:
        assert abs(taken[s] - target[s]) <= max(60, 0.05 * target[s]), s
    shards = [c.shard for r in got for c in r._copies]
    assert min(shards) >= 0 and max(shards) < 16 and all(len(r._copies) * r._size == r._taken for r in got)
    again = {(r.doc_id, tuple(r._copies)) for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, tuple(r._copies)) for r in got}
    assert mixing.mix(empty).count() == 0


def test_targets_and_tree():
    assert mixing.targets([100, 100, 0], [5, 2, 1], 300) == [200, 100, 0]
    assert sum(mixing.targets([10, 500, 90], [5, 2, 1], 900)) == pytest.approx(900)
    tree = mixing.splitting_tree([5, 0, 1000], 16, 3)
    assert tree.sum(axis=0).tolist() == [5, 0, 1000] and (tree >= 0).all()


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    x[50:70] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(800, None), (900, [0.0] * 24), (1000, [float("nan")] + [1.0] * 23), (1100, [None] + [1.0] * 23), (1200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    codes, coder = nearest.index(df)
    got = collections.defaultdict(list)
    for r in nearest.search(codes, coder, codes.where("vec_id % 100 = 0 or vec_id = 51")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == [0, 51, 100, 200, 300, 400, 500, 600]
    x, hits = x.astype(np.float64), 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(700), d)) if j != q][:10]
        hits += len(set(want) & {i for i, _ in found})
        assert all(s == pytest.approx(d[i], abs=1e-12) for i, s in found)
    assert hits >= 0.9 * 80 and [i for i, _ in got[51]] == [50, *range(52, 61)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    codes, coder = nearest.index(none)
    assert nearest.search(codes, coder, codes).count() == 0


def check_suffix_dedup(df, rows):
    length, grams = 200, collections.Counter()
    for _, t in rows:
        grams.update(t[p : p + length] for p in range(len(t) - length + 1))
    want = collections.Counter()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if grams[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        want[i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove(df).collect())
    assert got == want


@pytest.mark.parametrize("crowd", [512, 1])
def test_suffix_dedup(docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    check_suffix_dedup(docs, [(r[0], (r[1] or "").encode()) for r in corpus()])
    assert suffix_dedup.remove(empty).count() == 0


@pytest.mark.parametrize("crowd", [512, 1])
def test_suffix_dedup_of_passages_cut_anywhere(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = np.random.default_rng(7)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, texts = say(900), []
    for _ in range(60):
        at = int(rng.integers(0, 700))
        texts.append(say(int(rng.integers(0, 150))) + passage[at : at + int(rng.integers(190, 420))] + say(int(rng.integers(0, 150))))
    rows = list(enumerate(texts + texts[:3]))
    check_suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), [(i, t.encode()) for i, t in rows])


def test_repeated_grams_of_a_block():
    rng = np.random.default_rng(6)
    block = rng.integers(97, 99, 3000).astype(np.uint8)
    block[1000:1400], block[2003:2403] = block[100:500], block[100:500]
    starts = np.arange(2700)
    grams = collections.Counter(bytes(block[p : p + 200]) for p in starts)
    want = [grams[bytes(block[p : p + 200])] > 1 for p in starts]
    assert suffix_dedup.repeated(np.concatenate([block, np.zeros(400, np.uint8)]), starts, 200).tolist() == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy this now, it is cheap and good.</div><div class="cookie-banner">We use cookies on this site, please agree.</div>
<div class="main-content"><article class="post-12"><h1>A &amp; B</h1><p><b>First   line<br><p>Second paragraph has words, and more of them.</p><!-- x --><div class="share">Share</div></article>
<section id="comments"><p>Great article, thank you very much for it.</p></section></div><aside><p>Another story that you may like to read.</p></aside><footer>&copy; x</footer></body></html>"""


def test_html(spark, empty):
    rows = [(1, "https://a.b/x", PAGE, 1), (2, "https://a.b/y", None, 1), (3, None, "", 1), (4, "https://a.b/z", "<p>unclosed &am <i>text", 1), (1, "https://a.b/x", PAGE, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = collections.defaultdict(list)
    for r in html_text.extract(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert got[1] == ["A & B\nFirst line\nSecond paragraph has words, and more of them."] * 2
    assert got[2] == [""] and got[3] == [""] and got[4] == ["unclosed &am text"]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ('Two <span class="ad">Buy <span>now</span> cheap</span> words.', "Two words."),
        ('Read <a class="share" href="/s">Share <b>this</b></a> on.', "Read on."),
        ('One <a href="/x">linked</a> word <span class="ad">never closed', "One linked word"),
        ('<header class="entry-header"><h2>Its own heading</h2></header>', "Its own heading"),
        ('<section class="post-header"><h2>Its own heading</h2></section>', "Its own heading"),
        ('<div class="site-header">Our site</div>', ""),
        ("text <!-- a > comment without an end", "text"),
        ("one <b unended", "one <b unended"),
    ],
)
def test_html_inside_an_article(markup, want):
    prose = "This paragraph is the article, with words enough to be told from all that is around it."
    got = html_text.read(f"<html><body><div class=page-header>Top</div><article><p>{prose}</p><div>{markup}")[0]
    assert got.split("\n") == [prose, *([want] if want else [])]


def test_html_that_is_deep_or_broken_takes_time_in_proportion():
    import time

    begun = time.process_time()
    for source in ("<div>" * 100_000 + "x", "<a " * 100_000, "<center>" * 50_000 + "</b1>" * 50_000, "<p " * 50_000 + "<!--" * 50_000, "<span class=ad>" * 50_000):
        page = html_text.Page(source)
        assert page.best(1) == [] or page.best(1)
    assert html_text.read("<div class=a>" * 3000 + "Some words. " * 9)[1].count("div.a") == 3000
    assert time.process_time() - begun < 60


def test_sharding(docs, empty, spark):
    for df in (docs, docs.unionByName(docs).unionByName(docs), spark.createDataFrame([(i, "same") for i in range(100)], "doc_id long, text string")):
        rows = sharding.label_propagation_shards(df).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        counts = [len(by[s]) for s in range(16)]
        assert len(rows) == df.count() and max(counts) - min(counts) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    text = {r[0]: (r[1] or "").encode() for r in corpus()}
    groups = collections.defaultdict(set)
    for r in sharding.label_propagation_shards(docs).collect():
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
        groups[text[r.doc_id]].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 3
    assert sharding.label_propagation_shards(empty).count() == 0


@pytest.mark.parametrize(("width", "threshold"), [(4, 85), (5, 80), (1, 50)])
def test_ngram_join(docs, empty, width, threshold):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in corpus():
        w = WORD.findall((r[1] or "").translate(lower))
        sets[r[0]] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = ngram_join.join(docs, width, threshold).collect()
    assert len(got) == len(corpus())
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), find(i)) for i, s in sets.items()}
    if width == 4:
        assert ngram_join.join(empty).count() == 0


def test_points_bound_the_overlap():
    rng = np.random.default_rng(3)
    for a, b in ((40, 700), (3000, 2900), (2500, 90), (5000, 5000)):
        both = rng.integers(0, 1 << 63, 2 * (a + b), dtype=np.uint64)
        x, y = np.unique(both[:a]), np.unique(both[a // 3 : a // 3 + b])
        p, q = ngram_join.aligned([ngram_join.point(x), ngram_join.point(y)])
        assert len(np.intersect1d(x, y)) <= np.minimum(p, q).sum(dtype=np.int64) <= min(len(x), len(y))
    crowded = ngram_join.point(np.arange(300, dtype=np.uint64) << np.uint64(20))  # all in one group
    p, q = ngram_join.aligned([crowded, ngram_join.point(x)])
    assert np.minimum(p, p).sum() >= 300 and np.minimum(p, q).sum() >= q[0]


def test_ngram_join_of_large_sets(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 6000)]
    other = [f"v{k}" for k in rng.integers(0, 10**6, 6000)]
    near, half = words[:2900] + ["x"] + words[2900:3000], words[:1500] + other[:1500]
    texts = [words[:3000], near, half, other[1500:4500], words[100:3000], words[3000:]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 5}
