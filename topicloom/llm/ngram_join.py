"""Exact Jaccard self-join of word n-gram sets with count-vector R-trees.

Shingles are hashed to 64 bits; a set is its hashes. Documents with equal sets are one class from the start. Two sets of
sizes a and b that reach the threshold t differ in at most (a + b)(1 - t)/(1 + t) shingles. So if the shingles are dealt by
hash into more groups than that, some group is equal in both: the hashes of groups are the keys under which classes
meet. Groups with few shingles or none are equal in many unrelated texts, so there are `spare` groups more, and each set
leaves out as many, those with the fewest shingles, of equals the first: of the spare + 1 groups at least that are equal
in both sets the last by this order is left out by neither. Sizes fall into bands of ratio 1/t; a document has the keys
of its band and of the next one.

Under a key, first every class meets the one that has most keys in common with others, the original of many copies for
one; links found so join classes to components. Once more each key's members meet the one with most keys outside the
first one's component. Keys that still hold several components go to count-vector R-trees, those with the same least
member as one group: a class is the point of how many of its shingles fall into each of at least DIMS groups, more for
large sets, so that a group has LOAD shingles at most on average; a node keeps its points' coordinate maxima, and the sum
over coordinates of the smaller of a query's count and the node's maximum bounds the overlap. Points, a byte a group, are
made in the first pass over the texts. A member gives its best candidates outside its component that no one has tried; those that pass the
bound are verified on their sets, which are only made of texts that are asked for. Groups of keys that had more candidates
come again with a larger allowance until none has.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import slices
from .rolling import Sums, mix

DIMS = 128
#: Of so many groups that may differ there is one more that is left out.
SPARE = 8
#: Shingles of a set in a group of its point, on average, at most.
LOAD = 12
FAN = 16
#: Members of a group of keys that one R-tree holds; groups with more are searched in pairs of blocks.
TREE = 1024
#: Candidates that a member of a group gives in the first round; eight times as many in each later one.
BEST = 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each text's distinct shingles, sorted. A text of fewer words has its whole sequence as one."""
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[buf]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, starts, side="right")
    word = Sums(buf).hash(starts, ends)
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    place = np.arange(len(word)) - first[owner]
    full = np.flatnonzero(place + width <= n[owner])
    h = np.zeros(len(full), np.uint64)
    for j in range(width):
        h = mix(h + word[full + j] * np.uint64(2 * j + 3))
    short = np.flatnonzero((n > 0) & (n < width))
    few = np.zeros(len(short), np.uint64)
    for j in range(width - 1):
        more = n[short] > j
        few[more] = mix(few[more] + word[first[short[more]] + j] * np.uint64(2 * j + 3))
    few = mix(few + np.uint64(0x51ED270B))
    who, h = np.concatenate([owner[full], short]), np.concatenate([h, few])
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (who[1:] != who[:-1]) | (h[1:] != h[:-1])
    return who[keep], h[keep]


def classes(who: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, hash of the set) of each text."""
    n = np.bincount(who, minlength=texts)
    total = np.zeros(texts, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        total[some] = np.add.reduceat(mix(h), at) + mix(np.add.reduceat(mix(h + np.uint64(77)), at))
    return n, mix(total + n.astype(np.uint64))


def band(n: np.ndarray, t: int) -> np.ndarray:
    """The k with r^k <= n < r^(k+1), r = 100/t; from a table, so that it is the same everywhere."""
    return np.searchsorted(_edges(t, int(n.max(initial=1))), n, side="right") - 1


def _edges(t: int, upto: int) -> np.ndarray:
    edges, x = [1], 1.0
    while edges[-1] <= upto:
        x *= 100 / t
        edges.append(max(edges[-1], math.ceil(x - 1e-9)))
    # every band: its least size; equal edges make empty bands
    return np.array(edges, np.int64)


def keys(who: np.ndarray, h: np.ndarray, n: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of each text's groups for its band and the next."""
    out_who, out_key = [], []
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = np.maximum(n, 1)
    own = band(some, t)
    edges = _edges(t, int(some.max()) * 2 + 10)
    mixed = mix(h ^ np.uint64(0xA5A5))
    for step in (0, 1):
        level = own + step
        most = edges[level + 1] - 1  # no set in the band is larger
        differ = 2 * most * (100 - t) // (100 + t)
        spare = 2 + differ // SPARE
        groups = differ + 1 + spare
        base = np.cumsum(groups) - groups
        g = ((mixed >> np.uint64(32)) * groups[who].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cell = base[who] + g
        total, count = np.zeros(int(groups.sum()), np.uint64), np.bincount(cell, minlength=int(groups.sum()))
        order = np.argsort(cell, kind="stable")
        filled = np.flatnonzero(count)
        total[filled] = np.add.reduceat(mixed[order], (np.cumsum(count) - count)[filled])
        text = np.repeat(np.arange(len(n)), groups)
        inner = np.arange(len(text)) - base[text]
        use = (n[text] > 0) & ~_fewest(text, count, base, spare)
        tag = (level[text] << 40 | inner).astype(np.uint64)
        key = mix(total + mix(tag) + count.astype(np.uint64))
        out_who.append(text[use])
        out_key.append(key[use].view(np.int64))
    return np.concatenate(out_who), np.concatenate(out_key)


def _fewest(text: np.ndarray, count: np.ndarray, base: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Marks the `spare` groups of each text with the fewest shingles; 63 and more are one, the first of equals go first.
    Groups lie text by text, from base on."""
    count = np.minimum(count, 63)
    upto = np.bincount(text * 64 + count, minlength=64 * len(base)).reshape(-1, 64).cumsum(axis=1)
    last = (upto < spare[:, None]).sum(axis=1)  # the count at which not all may be left out
    left = spare - np.where(last > 0, upto[np.arange(len(base)), last - 1], 0)
    tied = count == last[text]
    place = np.concatenate([[0], np.cumsum(tied)])
    return (count < last[text]) | (tied & (place[1:] - place[base[text]] <= left[text]))


def point(h: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by group; 255 and more are 255, which bounds nothing."""
    dims = DIMS
    while dims * LOAD < len(h):
        dims *= 2
    return np.minimum(np.bincount((h & np.uint64(dims - 1)).astype(np.int64), minlength=dims), 255).astype(np.uint8)


def aligned(points: list[np.ndarray]) -> np.ndarray:
    """[points, groups] counts; groups of the longer points are added up to those of the shortest."""
    dims = min(len(p) for p in points)
    if all(len(p) == dims for p in points):
        out = np.concatenate(points).reshape(-1, dims)
        return _opened(out) if (out == 255).any() else out
    return np.stack([_opened(p).reshape(-1, dims).sum(axis=0) for p in points])


def _opened(x: np.ndarray) -> np.ndarray:
    return np.where(x == 255, 1 << 40, x.astype(np.int64))


def enough(a, b, t: int):
    """The least overlap of sets of sizes a and b that link: 100 i >= t (a + b - i)."""
    return -(-t * (a + b) // (100 + t))


class RTree:
    """Count vectors, packed by repeatedly sorting on the coordinate that varies most; nodes keep maxima and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = self._tile(np.arange(len(points)))
        high, small = points[self.order], sizes[self.order]
        self.levels = [(high, small)]
        while len(high) > FAN:
            cut = np.arange(0, len(high), FAN)
            high, small = np.maximum.reduceat(high, cut), np.minimum.reduceat(small, cut)
            self.levels.append((high, small))

    def _tile(self, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= FAN:
            return rows
        axis = self.points[rows].var(axis=0).argmax()
        rows = rows[np.argsort(self.points[rows, axis], kind="stable")]
        half = -(-len(rows) // (2 * FAN)) * FAN
        return np.concatenate([self._tile(rows[:half]), self._tile(rows[half:])])

    def search(self, points: np.ndarray, sizes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, bound): pairs whose overlap may suffice, level by level for all queries at once."""
        top = len(self.levels[-1][0])
        query, at = np.repeat(np.arange(len(points)), top), np.tile(np.arange(top), len(points))
        for k in range(len(self.levels) - 1, -1, -1):
            high, small = self.levels[k]
            bound = np.concatenate([np.zeros(0, np.int64), *(np.minimum(high[at[i : i + 4096]], points[query[i : i + 4096]]).sum(axis=1, dtype=np.int64) for i in range(0, len(at), 4096))])
            may = bound >= enough(sizes[query], small[at], t)
            query, at, bound = query[may], at[may], bound[may]
            if k:
                query, at = np.repeat(query, FAN), (at[:, None] * FAN + np.arange(FAN)).reshape(-1)
                inside = at < len(self.levels[k - 1][0])
                query, at = query[inside], at[inside]
        return query, self.order[at], bound


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def survivors(ids: np.ndarray, comps: np.ndarray, points: np.ndarray, sizes: np.ndarray, side: np.ndarray, t: int, best: int, tried: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(smaller, larger, more): pairs of different components whose points allow a link, at most `best` of each member,
    those with the highest bound; more: some member had further ones. side: 0 or 1 for the two blocks, which are only
    compared with each other, or 2 for members of one block compared among themselves. tried: (row, id) of pairs that
    are left out and take no member's place."""
    held, asks = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    none = np.zeros(0, np.int64)
    if not len(held) or not len(asks):
        return none, none, False
    query, row, bound = RTree(points[held], sizes[held]).search(points[asks], sizes[asks], t)
    i, j = held[row], asks[query]
    use = (comps[i] != comps[j]) & ((side[j] == 1) | (ids[i] != ids[j]))
    if tried is not None and len(tried[0]):
        by_id = np.argsort(ids)
        at = by_id[np.minimum(np.searchsorted(ids, tried[1], sorter=by_id), len(ids) - 1)]
        here = ids[at] == tried[1]
        known, at = tried[0][here], at[here]
        use &= ~np.isin(np.minimum(i, j) * len(ids) + np.maximum(i, j), np.minimum(known, at) * len(ids) + np.maximum(known, at))
    i, j, bound = i[use], j[use], bound[use]
    order = np.lexsort((ids[i], -bound, j))
    i, j = i[order], j[order]
    place = np.arange(len(j)) - np.searchsorted(j, j)
    first = place < best
    return np.minimum(ids[i], ids[j])[first], np.maximum(ids[i], ids[j])[first], not first.all()


def join(docs: DataFrame, width: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row, as linked() has them."""
    return linked(docs, width, threshold).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, width: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, root, component_id for each row: links are 100 * overlap >= threshold * union of shingle sets.

    component_id is the smallest doc_id that links reach, the row's own if none. Texts that are null, empty or without
    words have no shingles and no links. Rows of one doc_id are one node if their sets are equal; else each row has its own
    set's component. A null id is ignored as a smallest id, and stays null where nothing else is reached. An empty table
    gives no rows. Other columns are ignored. Equal 64-bit hashes count as equal shingles.

    root tells components apart, whatever their ids; it is null where there are no shingles. text_hash is xxhash64(text).
    A node is the hash of a class; ids count only when the components are done.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def read(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19):
        for whole in batches:
            for b in slices(whole, limit):
                texts = [t.as_py().encode() for t in b.column("text")]
                who, h = shingles(texts, width)
                yield (b, who, h, *classes(who, h, len(texts)))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, who, h, n, c in read(batches):
            ends = np.cumsum(n)
            points = pa.array([k.to_bytes(8, "little") + point(h[e - k : e]).tobytes() if k else None for e, k in zip(ends.tolist(), n.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(c.view(np.int64)), points], names=["doc_id", "text_hash", "n", "c", "point"])

    with common.wide_rows(spark, 4096):
        sized = common.table(lean.mapInArrow(sizes, "doc_id long, text_hash long, n long, c long, point binary"), "ngram-sizes")
    # point: the set's size, eight bytes, and its counts; one: a row that has the class's set
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")
    nodes = sized.where("n > 0").groupBy(F.col("c").alias("node")).agg(one, F.first("n").alias("n"), F.first("point").alias("point"))
    nodes = common.table(nodes.select("node", "one.*", "n", "point"), "ngram-classes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class that the task meets its keys, once."""
        had = np.zeros(0, np.uint64)
        for _, who, h, n, c in read(batches):
            kinds, at = np.unique(c, return_index=True)
            new = np.zeros(len(n), bool)
            new[at[~np.isin(kinds, had)]] = True
            had = np.union1d(had, kinds)
            who, h, n = who[new[who]], h[new[who]], np.where(new, n, 0)
            text, key = keys(who, h, n, threshold)
            for at in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 16)]), pa.array(c[text[at : at + (1 << 16)]].view(np.int64))], names=["key", "c"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and class: distinct ones under keys with two classes or more, with the first class."""
        last_key, first, pending, key_open = None, None, False, False
        for b in batches:
            key, c = b.column("key").to_numpy(), b.column("c").to_numpy()
            if not len(key):
                continue
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])])
            if last_key is not None and key[0] == last_key[0] and c[0] == last_key[1]:
                new[0] = False
            k, v = key[new], c[new]
            start = np.concatenate([[True], k[1:] != k[:-1]])
            carried = len(k) and last_key is not None and k[0] == last_key[0]
            if carried:
                start[0] = False
            at = np.maximum.accumulate(np.where(start, np.arange(len(k)), -1))
            lead = np.where(at >= 0, v[np.maximum(at, 0)], first if first is not None else 0)
            inner = np.flatnonzero(~start)  # a second or later class
            out_k, out_c, out_f = k[inner], v[inner], lead[inner]
            if len(k):
                first = lead[-1]
            last_key = (key[-1], c[-1])
            if len(out_k):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (out_k, out_c, out_f)], names=["key", "c", "least"])

    rows = lean.mapInArrow(keyed, "key long, c long")
    met = rows.repartition("key").sortWithinPartitions("key", "c").mapInArrow(meet, "key long, c long, least long")
    met = common.table(met, "ngram-keys")  # a class under a key, with the least class of the key
    common.release(spark)

    place = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "text_hash"]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of texts whose class is asked for."""
        for b, who, h, n, c in read(batches):
            want, ends = b.column("want").to_numpy(), np.cumsum(n)
            rows = np.flatnonzero(c.view(np.int64) == want)
            yield pa.RecordBatch.from_arrays([pa.array(want[rows], pa.int64()), pa.array([h[ends[i] - n[i] : ends[i]].tobytes() for i in rows], pa.binary())], names=["node", "hashes"])

    sets: list[DataFrame] = []
    held = lambda: functools.reduce(DataFrame.union, sets)

    def make_sets(pairs: DataFrame) -> None:
        """Writes the sets of classes that pairs name and that are not yet there; a text is read for each."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        if sets:
            asked = asked.join(held().select("node"), "node", "left_anti")
        asked = common.table(asked.join(nodes, "node").select(*place, F.col("node").alias("want")), "ngram-asked")
        # rows that repeat both id and text count once; of texts without an id one is enough, before they are dealt out
        some = _maybe(lean, asked)
        texts = some.where("doc_id is not null").union(some.where("doc_id is null").dropDuplicates(["text_hash"])).select(*place, "text")
        got = texts.join(asked, key := ["id", "none", "text_hash"]).dropDuplicates(key).select("want", "text")
        sets.append(common.table(got.mapInArrow(sets_of, "node long, hashes binary"), "ngram-sets"))
        common.discard(asked)

    def stars(pairs: DataFrame, blobs: DataFrame, parts: int, test, name: str) -> DataFrame:
        """Those of distinct pairs (a, b) that pass the test. What an a has goes to each salt of its partners once, about
        `parts` of them; test(centre, leaves) tells which of the leaves pass."""
        fan = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", F.greatest(F.lit(1), F.ceil(F.col("m") / parts)).alias("parts"))
        leaves = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"))
        centres = fan.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
        centres = centres.join(blobs.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "blob")
        leaves = leaves.join(blobs.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "blob")

        def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, of = None, None
            for batch in batches:
                a, b = batch.column("a").to_numpy(), batch.column("b").is_null().to_numpy(zero_copy_only=False)
                blob, out = batch.column("blob"), np.zeros(batch.num_rows, bool)
                for i, j in _runs(a, b):
                    if b[i]:
                        centre, of = np.frombuffer(blob[i].as_buffer(), np.uint8).copy(), a[i]
                        i += 1
                    if i < j and of == a[i]:
                        out[i:j] = test(centre, [np.frombuffer(blob[k].as_buffer(), np.uint8) for k in range(i, j)])
                yield batch.select(["a", "b"]).filter(pa.array(out))

        rows = centres.unionByName(leaves).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        with common.wide_rows(spark, 512):
            return common.table(rows.select("a", "b", "blob").mapInArrow(star, "a long, b long"), name)

    def near(centre: np.ndarray, leaves: list[np.ndarray]) -> np.ndarray:
        """Whether points allow a link."""
        n, size = np.array([x[:8].view(np.int64)[0] for x in leaves]), int(centre[:8].view(np.int64)[0])
        points = aligned([centre[8:], *(x[8:] for x in leaves)])
        return np.minimum(points[0], points[1:]).sum(axis=1, dtype=np.int64) >= enough(size, n, threshold)

    def linking(centre: np.ndarray, leaves: list[np.ndarray]) -> list[bool]:
        own, others = centre.view(np.uint64), [x.view(np.uint64) for x in leaves]
        return [_overlap(own, x) >= enough(len(own), len(x), threshold) for x in others]

    pointed = nodes.select("node", F.col("point").alias("blob"))

    def verify(pairs: DataFrame) -> DataFrame:
        make_sets(pairs)
        return stars(pairs, held().withColumnRenamed("hashes", "blob"), 64, linking, "ngram-links")

    tried = common.table(spark.createDataFrame([], "a long, b long"), "ngram-tried")
    links, roots = tried, nodes.limit(0).select("node", F.col("node").alias("root"))
    named = met.select("key", F.col("c").alias("node")).union(met.select("key", F.col("least").alias("node")).distinct())
    named = common.table(named, "ngram-members")
    common.discard(met)
    fame = common.table(named.groupBy("node").agg(F.count(F.lit(1)).alias("fame")), "ngram-fame")
    for first in (True, False):
        member = common.table(named.join(fame, "node").join(roots, "node", "left").select("key", "node", "fame", F.coalesce("root", "node").alias("comp")), "ngram-fame")
        heads = member.groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct("fame", "node")).alias("h")).select("key", F.col("h.node").alias("h"), F.col("h.comp").alias("hc"))
        # the first time the head meets all; later its component is done, and the next head outside it meets all others
        if not first:
            outside = member.join(heads, "key").where("comp <> hc")
            second = outside.groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct("fame", "node")).alias("g"))
            heads = second.select("key", F.col("g.node").alias("h"), F.col("g.comp").alias("hc"))
        heads = common.table(heads, "ngram-heads")
        pairs = member.join(heads, "key").where("node <> h" if first else "comp <> hc").select(F.col("h").alias("a"), F.col("node").alias("b")).distinct()
        pairs = common.table(pairs, "ngram-stars")
        passed = stars(pairs, pointed, 4096, near, "ngram-near")
        common.discard(member, heads, pairs)
        common.release(spark)
        links, tried = common.table(links.union(verify(passed)), "ngram-links"), common.table(tried.union(passed), "ngram-tried")
        common.discard(passed)
        roots = common.components(links, "a", "b")
        common.release(spark)

    # keys that hold several components
    member = common.table(named.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp")), "ngram-members")
    # keys with the same least member are one group: nearly equal member sets, which near copies have by the dozen, are
    # searched once, and each member is there once
    seen = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("group"))
    alive = common.table(seen.where("lo <> hi").select("key", "group"), "ngram-open")
    grouped = common.table(member.join(alive, "key").select(F.col("group").alias("key"), "node", "comp").distinct(), "ngram-groups")
    common.release(spark)
    blocks = grouped.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TREE).cast("int").alias("blocks"))
    more = grouped.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    more = more.select("key", "node", "comp", "block", F.explode(each).alias("pair")).select("key", "node", "comp", "pair.x", "pair.y", F.when(F.col("pair.x") == F.col("pair.y"), 2).when(F.col("block") == F.col("pair.x"), 0).otherwise(1).alias("side"))
    more = common.table(more, "ngram-more")
    common.discard(member, alive, grouped, named, fame)
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    best = BEST
    while not more.isEmpty():
        members = more.join(nodes.select("node", "n", "point"), "node").join(_known(tried), "node", "left")
        found = common.table(_searched(members, threshold, best), "ngram-trees")
        later = common.table(found.where("b is not null").distinct().join(tried, ["a", "b"], "left_anti"), "ngram-later")
        common.release(spark)
        if not later.isEmpty():
            links, tried = common.table(links.union(verify(later)), "ngram-links"), common.table(tried.union(later), "ngram-tried")
            roots = common.components(links, "a", "b")
        again = more.join(found.where("b is null").select(F.col("a").alias("key")).distinct(), "key", "left_semi").drop("comp").join(roots, "node", "left")
        more = common.table(again.select("key", "node", F.coalesce("root", "node").alias("comp"), "x", "y", "side"), "ngram-more")
        common.discard(found, later)
        best *= 8
    reached = common.table(nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "ngram-roots")
    least = reached.groupBy("root").agg(F.min("doc_id").alias("component"))
    final = common.table(reached.join(least, "root").select(F.col("node").alias("c"), "root", "component"), "ngram-roots")
    common.release(spark)
    common.discard(*sets, nodes, reached)
    some = sized.where("n > 0").join(final, "c", "left").select("doc_id", "text_hash", "n", "root", "component")
    out = some.union(sized.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("long"), F.col("doc_id").alias("component")))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root", F.coalesce("component", "doc_id").alias("component_id"))


def _maybe(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts whose text_hash one of `asked` may have, by its last bits, so that few others are dealt out; up to 2^26
    bits, 16 for each that is asked for, are broadcast as words of 64."""
    mask = (1 << min(26, max(10, (16 * asked.count()).bit_length()))) - 1
    word, bit = F.expr(f"shiftrightunsigned(text_hash & {mask}L, 6)"), F.expr("shiftleft(1L, cast(text_hash & 63L as int))")
    told = asked.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return texts.withColumn("_word", word).join(F.broadcast(told), "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def _runs(a: np.ndarray, opens: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows of equal a, also parted where a row opens one."""
    start = np.ones(len(a), bool)
    start[1:] = (a[1:] != a[:-1]) | opens[1:]
    at = np.flatnonzero(start).tolist()
    return list(zip(at, [*at[1:], len(a)]))


def _known(tried: DataFrame) -> DataFrame:
    """(node, known): the other nodes of its pairs (a, b); a pair is with the node that has fewer, so no list is long."""
    ends = tried.select(F.col("a").alias("node"), F.col("b").alias("other")).union(tried.select("b", "a"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    both = ends.join(degree, "node").join(degree.select(F.col("node").alias("other"), F.col("d").alias("e")), "other")
    return both.where("struct(d, node) < struct(e, other)").groupBy("node").agg(F.collect_list("other").alias("known"))


def _searched(members: DataFrame, threshold: int, best: int) -> DataFrame:
    """Pairs (a, b) of members of a group that R-trees let through and that are not known, and (key, null) of groups, named by key, that have more of them."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            batch = table.to_batches()[0] if table.num_rows else batch
            names = [batch.column(n).to_numpy() for n in ("key", "x", "y")]
            cut = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in names], axis=0)])) if batch.num_rows else np.zeros(0, np.int64)
            if len(cut):
                yield from solved(batch.slice(0, cut[-1]), cut[:-1])
                rest = batch.slice(cut[-1])
        if rest is not None and rest.num_rows:
            yield from solved(rest, np.zeros(1, np.int64))

    def solved(batch: pa.RecordBatch, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(cut):
            return
        key, ids, comps, sizes, side = (batch.column(n).to_numpy() for n in ("key", "node", "comp", "n", "side"))
        points, known, out = batch.column("point"), batch.column("known"), []
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows]):
            if (comps[i:j] != comps[i]).any():
                held = aligned([np.frombuffer(points[k].as_buffer(), np.uint8)[8:] for k in range(i, j)])
                of = known.slice(i, j - i)
                tried = np.repeat(np.arange(j - i), pc.fill_null(pc.list_value_length(of), 0).to_numpy()), of.flatten().to_numpy()
                a, b, more = survivors(ids[i:j], comps[i:j], held, sizes[i:j], side[i:j], threshold, best, tried)
                out.append((a, b, np.zeros(len(a), bool)))
                if more:
                    out.append((key[i : i + 1], key[i : i + 1], np.ones(1, bool)))
        if out:
            a, b, none = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=none)], names=["a", "b"])

    rows = members.select("key", "x", "y", "side", "node", "comp", "n", "point", "known").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    return rows.mapInArrow(forest, "a long, b long")
