"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents keep a random place u in [0, 1) from the hash of their id. A source that is to be taken f times is taken
whole floor(f) times and then up to a threshold on u, which a radix descent on hash prefixes finds exactly. Runs of u
are the source's blocks, once for each time that it is taken; those that hold documents are counted. The exact block
quotas of all sources are split in two, drawing the left half from the multivariate hypergeometric law, until each leaf
is an output shard. A shard draws its blocks of a source, disjoint, from their random permutation, and orders the
documents of all of them by another hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5, 2, 1)
BITS = 10
#: Documents about the threshold that may come to the driver, per source.
NEAR = 512
#: Blocks of an average shard.
BLOCKS = 256
#: Bytes of the sources' plan that may be broadcast; a larger one is joined by shuffle.
BROADCAST = 64 << 20


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight; a share stops at `most` times its size, and the excess is shared again by weight."""
    got, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / w >= most * sizes[i]}
        if not full:
            for i in open_:
                got[i] = left * weights[i] / w
            break
        for i in full:
            got[i] = most * sizes[i]
            left -= got[i]
        open_ -= full
        left = max(left, 0.0)
    return got


def splitting_tree(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """[shards, sources] block counts; columns sum to the quotas, rows differ by at most one per level."""
    rng = np.random.default_rng(seed)

    def split(q: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [q]
        half, total = n // 2, int(q.sum())
        method = "marginals" if total < 10**9 else "count"
        left = rng.multivariate_hypergeometric(q, total * half // n, method=method) if total else q
        return split(left, half) + split(q - left, n - half)

    return np.array(split(np.array(quotas, dtype=np.int64), shards))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 7) -> DataFrame:
    """docs with _size, _source_size, _target, _taken (words), _copies (array of shard and order within it).

    Sources in code point order, null last, get the weights in turn. _taken is 0, 1 or 2 times _size: documents are
    taken whole. A document without words is taken as often as others of its place; it counts no words. Rows with
    equal ids share their place, so they are taken alike. Each run gives the same rows. The driver holds a row for each
    source, at most a few times NEAR documents of each, and the blocks: about shards * BLOCKS and a few for each source. An
    empty table gives an empty one. Columns whose names start with
    an underscore are dropped.
    """
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if not c.startswith("_")))
    place = F.xxhash64("doc_id", F.lit(seed))
    sized = common.table(docs.select("source", place.alias("h"), common.words("text").alias("size")), "mix-sizes")
    prefix = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - BITS)  # order of h as a signed number
    bins = common.table(sized.groupBy("source", prefix.alias("bin")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-bins")
    found = {r.source: (r.w, r.n) for r in bins.groupBy("source").agg(F.sum("words").alias("w"), F.sum("n").alias("n")).collect()}
    sources = sorted((s for s in found if s is not None)) + [s for s in found if s is None]
    size = [int(found[s][0]) for s in sources]
    weight = [float(weights[i % len(weights)]) for i in range(len(sources))]
    aim = targets(size, weight, share * sum(size), most)
    whole = [min(int(t // s), int(most)) if s else 0 for t, s in zip(aim, size)]
    rest = [t - f * s if f < most else 0.0 for t, f, s in zip(aim, whole, size)]
    cuts = _thresholds(spark, sized, bins, sources, rest)

    unit = max(1.0, sum(aim) / (shards * BLOCKS))
    width = [max(1, math.ceil(s / unit)) for s in size]  # runs of u
    first = [(s, size[i], aim[i], whole[i], cuts[i][0], cuts[i][1], width[i]) for i, s in enumerate(sources)]
    kinds = "_s string, _source_size long, _target double, _whole int, _cut long, _more array<long>, _blocks long"
    held = _planned(sized.withColumnRenamed("h", "_h"), spark.createDataFrame(first, kinds), sum(8 * len(c[1]) + 64 for c in cuts))
    copies = held.where("_times > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("k"), "_block")
    blocks: list[list[tuple[int, int]]] = [[] for _ in sources]
    number = {s: i for i, s in enumerate(sources)}
    for r in copies.distinct().collect():
        blocks[number[r.source]].append((r.k, r._block))
    shard_of = draw(blocks, shards, seed)
    rows = []
    for f, place_of, w in zip(first, shard_of, width):
        where = np.full((int(most), w), -1, int)
        for (k, b), shard in place_of.items():
            where[k, b] = shard
        rows.append((*f, where.tolist()))
    plan = spark.createDataFrame(rows, f"{kinds}, _places array<array<int>>")
    out = _planned(docs.withColumn("_h", place).withColumn("_size", common.words("text")), plan, sum(8 * len(c[1]) + 4 * int(most) * w + 64 for c, w in zip(cuts, width)))

    def copy(k):
        shard = F.element_at(F.element_at("_places", k + 1), (F.col("_block") + 1).cast("int"))
        return F.struct(shard.alias("shard"), F.xxhash64(F.col("_h"), k, F.lit(seed)).alias("order"))

    copies = F.transform(F.slice(F.array(*(F.lit(i) for i in range(int(most)))), 1, F.col("_times")), copy)
    return out.withColumn("_taken", F.col("_times") * F.col("_size")).withColumn("_copies", copies).drop("_s", "_whole", "_cut", "_more", "_blocks", "_places", "_h", "_times", "_block")


def _planned(docs: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """docs (source, _h and others) with their source's plan, _times that each is taken, and its _block."""
    plan = F.broadcast(plan) if size <= BROADCAST else plan
    out = docs.join(plan, docs["source"].eqNullSafe(F.col("_s")))
    times = F.col("_whole") + F.when((F.col("_h") < F.col("_cut")) | F.array_contains("_more", F.col("_h")), 1).otherwise(0)
    block = F.least(F.floor((F.col("_h") + F.lit(2.0**63)) / F.lit(2.0**64) * F.col("_blocks")), F.col("_blocks") - 1)
    return out.withColumn("_times", times).withColumn("_block", block)


def draw(blocks: Sequence[Sequence], shards: int, seed: int) -> list[dict]:
    """For each source the shard of each of its blocks: the tree gives a shard its number of them, a permutation which."""
    if not blocks:
        return []
    ends = np.cumsum(splitting_tree([len(b) for b in blocks], shards, seed), axis=0)
    rng = np.random.default_rng([seed, 1])
    out = []
    for i, own in enumerate(blocks):
        own = sorted(own)
        mixed = [own[j] for j in rng.permutation(len(own))]
        out.append(dict(zip(mixed, np.searchsorted(ends[:, i], np.arange(len(own)), side="right").tolist())))
    return out


def _thresholds(spark, sized: DataFrame, bins: DataFrame, sources: list, rest: list[float]) -> list[tuple[int, list[int]]]:
    """For each source (cut, more): documents with h < cut or h in more hold about `rest` words."""
    lowest = -(1 << 63)
    cuts: dict = {s: (lowest, []) for s in sources}
    need = {s: r for s, r in zip(sources, rest) if r > 0}
    base = {s: 0 for s in need}  # the prefix that the bins of a source share
    used, got = 0, {s: 0.0 for s in need}
    while need:
        used += BITS
        told = spark.createDataFrame([(s, float(need[s] - got[s])) for s in need], "_s string, need double")
        run = Window.partitionBy("source").orderBy("bin")
        at = bins.join(F.broadcast(told), bins["source"].eqNullSafe(told["_s"])).withColumns({"upto": F.sum("words").over(run), "docs": F.sum("n").over(run)})
        at = at.withColumn("ahead", F.sum(F.when(F.col("upto") <= F.col("need"), F.col("n")).otherwise(0)).over(Window.partitionBy("source")))
        # the bin that reaches past the need, and those about it that hold the nearest documents
        passed = F.col("docs") - F.col("n") - F.col("ahead")
        near = at.where((F.col("upto") > F.col("need")) & (passed < NEAR) | (F.col("upto") <= F.col("need")) & (F.col("ahead") - F.col("docs") < NEAR))
        by: dict = {}
        for r in near.select("source", "bin", "words", "n", "upto").collect():
            by.setdefault(r.source, []).append(r)
        deeper, fetch = {}, []
        for s in list(need):
            rows = sorted(by.get(s, []), key=lambda r: r.bin)
            ahead = need[s] - got[s]
            first = next((r for r in rows if r.upto > ahead), None)
            if first is None:  # all of it is needed
                cuts[s] = ((1 << 63) - 1, [])
                continue
            if first.n <= 8 * NEAR:  # start with some that are surely taken, so that they can be exchanged
                k = rows.index(first)
                while k and sum(r.n for r in rows[k - 1 : rows.index(first) + 1]) <= 8 * NEAR:
                    k -= 1
                rows = rows[k:]
                first = rows[0]
            else:
                rows = rows[rows.index(first) :]
            got[s] += first.upto - first.words
            if first.n > 8 * NEAR and used + BITS <= 60:
                deeper[s] = (base[s] << BITS) | first.bin if used > BITS else first.bin
            else:
                width = 1 << (64 - used)
                start = ((base[s] << BITS) | first.bin if used > BITS else first.bin) * width + lowest
                last, count = first, 0
                for r in rows:
                    last, count = r, count + r.n
                    if count > 8 * NEAR:
                        break
                stop = ((base[s] << BITS) | last.bin if used > BITS else last.bin) * width + width + lowest - 1
                fetch.append((s, start, stop))
        if fetch:
            spans = spark.createDataFrame(fetch, "_s string, lo long, hi long")
            these = sized.join(F.broadcast(spans), sized["source"].eqNullSafe(spans["_s"]) & F.col("h").between(F.col("lo"), F.col("hi")))
            some: dict = {}
            for r in these.groupBy("source", "h").agg(F.sum("size").alias("size")).collect():
                some.setdefault(r.source, []).append((r.h, r.size))
            for s, start, _ in fetch:
                cuts[s] = (start, _choose(sorted(some.get(s, [])), need[s] - got[s]))
        need = {s: need[s] for s in deeper}
        base.update(deeper)
        if need:
            told = spark.createDataFrame([(s, int(base[s])) for s in need], "_s string, at long")
            flipped = F.col("h").bitwiseXOR(F.lit(lowest))
            inside = sized.join(F.broadcast(told), sized["source"].eqNullSafe(told["_s"]) & (F.shiftrightunsigned(flipped, 64 - used) == F.col("at")))
            bins = common.table(inside.groupBy("source", F.shiftrightunsigned(flipped, 64 - used - BITS).bitwiseAND(F.lit((1 << BITS) - 1)).alias("bin")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-bins")
    return [cuts[s] for s in sources]


def _choose(rows: list[tuple[int, int]], left: float) -> list[int]:
    """Places, taken in order as far as they fit into `left` words; then one is exchanged, or added, if that comes nearer."""
    taken, out = [], []
    for h, n in rows:
        if n <= left:
            left -= n
            taken.append((n, h))
        else:
            out.append((n, h))
    if out:
        give, take = np.array([0] + [n for n, _ in taken]), np.array([n for n, _ in out])
        rest = np.abs(left - (take[None, :] - give[:, None]))
        i, j = divmod(int(rest.argmin()), len(take))
        if rest[i, j] < left:
            if i:
                taken.pop(i - 1)
            taken.append(out[j])
    return [h for _, h in taken]


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each copy: the columns, with shard and order in which the shard holds it."""
    return mixed.select(*columns, F.explode("_copies").alias("_c")).select(*columns, F.col("_c.shard").alias("_shard"), F.col("_c.order").alias("_order"))


def in_shards(mixed: DataFrame, columns: list[str], shards: int = 16) -> DataFrame:
    """The columns of each copy, dealt to shards and put into their order: a shard is a run of partitions, so a run of files
    when this is written, each with a range of the order."""
    parts = max(1, -(-common.partitions(mixed.sparkSession) // shards))
    spread = F.least(F.floor((F.col("_order") + F.lit(2.0**63)) / F.lit(2.0**64) * parts), F.lit(parts - 1))
    rows = expand(mixed, columns).withColumn("_part", (F.col("_shard") * parts + spread).cast("int"))
    return rows.repartitionById(shards * parts, "_part").sortWithinPartitions("_part", "_order").select(*columns)
