"""Removal of byte strings that occur more than once, by blockwise suffix sorting with a difference cover.

1. Every gram (200 bytes) contains an anchor: of its 161 stretches of 40 bytes the one with the smallest hash, the first
   of equals. Equal grams have equal anchors at equal places. Grams that share an anchor are a run of starts, and the
   bytes that they cover are the anchor's context.
2. Anchors are counted by hash. One that occurs once has no repeated gram. Where an equal context occurs again, all its
   grams are repeated. What remains are anchors that occur in different contexts: edges of repeated passages.
3. Contexts about such anchors, one of each kind, are gathered by anchor into blocks of bounded size, and the suffixes of a
   block are sorted: first all by 13 bytes, then one bucket after another, long ties by the ranks of a sample. The sample
   holds the positions whose residue modulo 13 is in a difference cover, ranked in advance by doubling, so that any two
   suffixes have a sampled position at an equal distance of less than 13 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import slices
from .rolling import Sums, mix

ANCHOR = 40
#: A perfect difference cover: every residue modulo 13 is a difference of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Gram starts of a long text that are looked at together, and bytes of a block of contexts.
PART, BLOCK = 1 << 19, 1 << 20
#: Suffixes of a bucket.
BUCKET = 1 << 18
#: Contexts of an anchor that are sorted in one block; of more, grams are counted by their hashes instead: first those of
#: STRETCH neighbouring starts as one, by all bytes that they cover (if equal, all are repeated) and by those that they
#: share (if not equal, none is), then the grams of stretches that this leaves open.
CROWD, STRETCH = 512, 16


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first gram start, last, anchor, anchor's hash, context's hash), a row for each run of grams."""
    owner, base, pieces = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, PART):
            owner.append(i)
            base.append(at)
            pieces.append(t[at : at + PART + length - 1])
    none = np.zeros(0, np.int64)
    if not pieces:
        return none, none, none, none, none, none
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes) - sizes
    sums = Sums(np.frombuffer(b"".join(pieces), np.uint8))
    hashes = sums.all(ANCHOR)
    least = hashes & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    window, done = length - ANCHOR + 1, 1
    while done < window:
        step = min(done, window - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    count = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    at = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
    chosen = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    lo, hi, anchor, piece = at[first], at[last], chosen[first], piece[first]
    context = mix(sums.hash(lo, hi + length) + ((anchor - lo) << 32 | (hi - lo)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    shift = np.array(base, np.int64)[piece] - starts[piece]
    return np.array(owner, np.int64)[piece], lo + shift, hi + shift, anchor + shift, hashes[anchor].view(np.int64), context.view(np.int64)


def _classes(*keys: np.ndarray) -> np.ndarray:
    """Numbers that are equal where all keys are; they follow the order of the keys."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def repeated(block: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each start's gram occurs at another of the starts. block must go on for 16 bytes after the last gram."""
    n = len(block) - 8
    words = np.lib.stride_tricks.sliding_window_view(block, 8)[: n + 1].copy().view(">u8").reshape(-1).astype(np.uint64)
    # ranks by the first PERIOD bytes, of all positions that are asked for
    tail = [length - PERIOD, length - 2 * PERIOD + 1]
    reach = (length - PERIOD) // PERIOD * PERIOD  # bytes to which the sample is ranked
    use = np.zeros(n + 1, bool)
    for d in (0, *tail):
        use[starts + d] = True
    residue = np.arange(n + 1) % PERIOD
    sampled = np.isin(residue, COVER)
    need = np.zeros(n + 2, np.int64)
    np.add.at(need, starts, 1)
    np.add.at(need, np.minimum(starts + PERIOD + reach, n + 1), -1)
    sample = np.flatnonzero(sampled & (np.cumsum(need[:-1]) > 0))
    use[sample] = True
    where = np.flatnonzero(use)
    where = where[where + PERIOD <= len(block)]
    by13 = np.full(n + 1 + length, -1, np.int64)
    by13[where] = _classes(words[where], words[np.minimum(where + PERIOD - 8, n)])
    # the sample, doubled from PERIOD bytes to reach bytes
    rank = np.full(n + 1 + 2 * length, -1, np.int64)
    rank[sample] = by13[sample]
    done = PERIOD
    while done < reach:
        step = min(done, reach - done)
        rank[sample] = _classes(rank[sample], rank[sample + step])
        done += step
    out = np.zeros(len(starts), bool)
    order = np.argsort(by13[starts], kind="stable")
    ranks = by13[starts[order]]
    at = 0
    distance = np.array([[(d + r) % PERIOD in COVER for r in range(PERIOD)] for d in range(PERIOD)])
    while at < len(order):
        to = min(at + BUCKET, len(order))
        if to < len(order):  # a bucket ends with its last tie
            to = int(np.searchsorted(ranks, ranks[to - 1], side="right"))
        mine = order[at:to]
        tied = ranks[at:to]
        same = np.zeros(len(mine), bool)
        same[1:] = tied[1:] == tied[:-1]
        same[:-1] |= same[1:]
        mine = mine[same]
        p = starts[mine]
        for d in range(PERIOD):
            ok = distance[d][residue[p]]
            if not ok.any():
                continue
            q = p[ok]
            key = [by13[q], rank[q + d], by13[q + tail[0]], by13[q + tail[1]]]
            one = mix((key[0] << 32 | key[1] & 0xFFFFFFFF).astype(np.uint64)) + mix((key[2] << 32 | key[3] & 0xFFFFFFFF).astype(np.uint64)) * np.uint64(3)
            o = np.argsort(one)
            eq = np.ones(max(0, len(o) - 1), bool)
            for k in key:
                s = k[o]
                eq &= s[1:] == s[:-1]
            hit = np.zeros(len(o), bool)
            hit[1:] |= eq
            hit[:-1] |= eq
            found = np.zeros(len(o), bool)
            found[o] = hit
            out[mine[ok]] |= found
        at = to
    return out


def remove(docs: DataFrame, length: int = 200, as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary): the bytes that no repeated string of `length` covers.
    With as_text kept is a string; what a cut leaves of a character is dropped from it.

    A string counts as repeated if it starts anywhere else, in the same text too; matches stay within a text, overlaps
    count, and strings are judged on the input. A null text counts as empty, shorter texts keep all. Rows with equal texts
    repeat each other. An empty table gives no rows. Columns with the names of results or of helpers (_uid, sure, asks,
    checked) are dropped. Equality of strings of 40 bytes and of contexts is decided by 64-bit
    hashes, of other strings by their bytes, but where more than CROWD contexts share an anchor.
    """
    spark = docs.sparkSession
    docs = docs.drop("_uid", "sure", "asks", "checked", "n_bytes", "n_removed", "n_spans", "kept")
    docs = docs.withColumn("_uid", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    lean = docs.select("_uid", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 18):
                uid = b.column("_uid").to_numpy()
                i, lo, hi, anchor, h, c = anchors([t.as_py().encode() for t in b.column("text")], length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, uid[i], lo, hi, anchor)], names=["h", "c", "uid", "lo", "hi", "anchor"])

    rows = lean.mapInArrow(found, "h long, c long, uid long, lo long, hi long, anchor long")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("mixed"))
    often = common.table(often.where("n > 1").select("h", "mixed"), "anchors")
    common.release(spark)
    at = common.table(rows.join(often, "h"), "repeated-anchors")
    common.release(spark)
    kinds = at.where("mixed").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "lo", "hi", "anchor")).alias("one"))
    kinds = common.table(kinds, "contexts")
    open_ = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).where("least = 1")
    # one of each kind of context about an open anchor
    asked = common.table(kinds.join(common.table(open_.select("h", "size"), "open-anchors"), "h").select("h", "n", "size", "one.*"), "asked-contexts")
    sure = at.where("not mixed").select("uid", "lo", "hi").union(at.where("mixed").join(kinds.where("n > 1").select("h", "c"), ["h", "c"]).select("uid", "lo", "hi"))
    of_text = sure.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("sure"))
    asks = asked.groupBy("uid").agg(F.collect_list(F.struct("h", "n", "size", "lo", "hi", "anchor")).alias("asks"))
    of_text = common.table(of_text.join(asks, "uid", "full").withColumnRenamed("uid", "_uid"), "of-texts")
    # the texts move once; only those with open anchors are looked at again
    joined = docs.join(of_text, "_uid", "left")
    joined = common.table(joined, "texts-with-anchors")
    common.release(spark)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 20):
                out: list[tuple] = []
                for uid, text, asks in zip(b.column("_uid").to_pylist(), b.column("text").to_pylist(), b.column("asks").to_pylist()):
                    data = text.encode()
                    out += [(a["h"], a["size"], a["n"], uid, a["lo"], a["anchor"], data[a["lo"] : a["hi"] + length]) for a in asks]
                if out:
                    kinds = [pa.int64()] * 6 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["h", "size", "n", "uid", "lo", "anchor", "context"])

    # equal texts ask for the same contexts
    askers = joined.where(F.col("asks").isNotNull()).select("_uid", "text", "asks")
    pieces = askers.mapInArrow(contexts, "h long, size long, n long, uid long, lo long, anchor long, context binary")
    answer = "uid long, lo long, hi long"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solve() -> pa.RecordBatch:
            nonlocal held, size
            rows = list(dict.fromkeys(held))
            block = bytearray()
            starts, owner, shift = [], [], []
            for k, (_, n, uid, lo, anchor, context) in enumerate(rows):
                block += bytes((-len(block)) % 8)
                starts.append(np.arange(len(context) - length + 1) + len(block))
                owner.append(np.full(len(starts[-1]), k))
                shift.append(lo - len(block))
                block += context
            held, size = [], 0
            block += bytes(2 * length)
            p, k = np.concatenate(starts), np.concatenate(owner)
            hit = repeated(np.frombuffer(bytes(block), np.uint8), p, length)
            out = _grouped(p[hit], k[hit], rows, shift)
            cols = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "lo", "hi"])

        for b in batches:
            for r in zip(*(b.column(n).to_pylist() for n in ("h", "n", "uid", "lo", "anchor", "context"))):
                if size >= BLOCK and r[0] != held[-1][0]:
                    yield solve()
                held.append(r)
                size += len(r[5])
        if held:
            yield solve()

    few = pieces.where(F.col("size") <= CROWD).drop("size").repartition("h").sortWithinPartitions("h", "uid", "lo").mapInArrow(sort, answer)

    def places(part: pa.RecordBatch) -> tuple:
        """Sums of the contexts, where their anchors lie in them, and the least and largest distance of a start to it."""
        size = np.array([len(c) for c in part.column("context").to_pylist()], np.int64)
        most = part.column("anchor").to_numpy() - part.column("lo").to_numpy()
        sums = Sums(np.frombuffer(b"".join(part.column("context").to_pylist()), np.uint8))
        return sums, np.cumsum(size) - size + most, most - (size - length), most

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sums, anchor, least, most = places(part)
                count = most // STRETCH - least // STRETCH + 1
                k = np.repeat(np.arange(len(count)), count)
                j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (least // STRETCH)[k]
                near, far = j * STRETCH, j * STRETCH + STRETCH - 1
                whole = (near >= least[k]) & (far <= most[k])
                shared = mix(sums.hash(anchor[k] - near, anchor[k] - far + length) + j.astype(np.uint64))
                every = np.zeros(len(j), np.uint64)
                every[whole] = mix(sums.hash((anchor[k] - far)[whole], (anchor[k] - near + length)[whole]) + j[whole].astype(np.uint64))
                cols = [pa.array(every.view(np.int64), mask=~whole), pa.array(shared.view(np.int64)), pa.array(j)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(part.column(n).to_numpy()[k]) for n in ("h", "n", "uid", "lo", "anchor")], names=["every", "shared", "j", "h", "n", "uid", "lo", "anchor"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sums, anchor, least, most = places(part)
                held = part.column("open").to_pylist()
                k = np.repeat(np.arange(len(held)), [STRETCH * len(x) for x in held])
                j, mark = (np.repeat(np.array([y[n] for x in held for y in x], kind), STRETCH) for n, kind in (("j", np.int64), ("mark", bool)))
                d = j * STRETCH + np.arange(len(j)) % STRETCH
                own = (d >= least[k]) & (d <= most[k])
                k, d = k[own], d[own]
                key = sums.hash(anchor[k] - d, anchor[k] - d + length)
                cols = [key.view(np.int64), mark[own], part.column("uid").to_numpy()[k], part.column("anchor").to_numpy()[k] - d]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "mark", "uid", "lo"])

    if asked.where(F.col("size") > CROWD).isEmpty():
        many = spark.createDataFrame([], answer)
    else:
        crowd = common.table(pieces.where(F.col("size") > CROWD).dropDuplicates(["h", "uid", "lo"]).drop("size"), "crowds")
        cells = common.table(crowd.mapInArrow(stretches, "every long, shared long, j long, h long, n long, uid long, lo long, anchor long"), "stretches")
        alike = cells.where("every is not null").groupBy("every").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("h", "uid", "lo", "j", "shared")).alias("one"))
        alike = common.table(alike.where("m > 1").select("every", "one"), "equal-stretches")
        runs = cells.where("n = 1").join(alike.select("every"), "every")
        runs = runs.select("uid", (F.col("anchor") - F.col("j") * STRETCH - (STRETCH - 1)).alias("lo"), (F.col("anchor") - F.col("j") * STRETCH).alias("hi"))
        # where not all is equal grams are compared, also with one of each kind of equal stretches
        partly = cells.groupBy("shared").agg(F.count(F.lit(1)).alias("m"), F.count("every").alias("whole"), F.min("every").alias("a"), F.max("every").alias("z"))
        partly = common.table(partly.where("m > 1 and (whole < m or a <> z)").select("shared"), "shared-stretches")
        rest = cells.join(alike.select("every"), "every", "left_anti").select("h", "uid", "lo", "j", "shared", (F.col("n") == 1).alias("mark"))
        rest = rest.union(alike.select("one.*", F.lit(False).alias("mark"))).join(partly, "shared", "left_semi")
        rest = rest.groupBy("h", "uid", "lo").agg(F.collect_list(F.struct("j", "mark")).alias("open"))
        exploded = common.table(crowd.join(rest, ["h", "uid", "lo"]).mapInArrow(grams, "g long, mark boolean, uid long, lo long"), "grams")
        twice = exploded.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g")
        many = runs.union(exploded.where("mark").join(twice, "g").select("uid", "lo", F.col("lo").alias("hi")))
    found_ = few.union(many).groupBy(F.col("uid").alias("_uid")).agg(F.collect_list(F.struct("lo", "hi")).alias("checked"))
    found_ = common.table(found_, "checked-grams")
    common.release(spark)

    names = [f.name for f in docs.schema.fields if f.name != "_uid"]
    schema = common.pack(f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    out_schema = docs.drop("_uid").schema
    for f in schema.fields:
        out_schema = out_schema.add(f)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 22):
                rows = []
                for text, sure, checked in zip(b.column("text").to_pylist(), b.column("sure").to_pylist(), b.column("checked").to_pylist()):
                    data = (text or "").encode()
                    kept, at, spans = [], 0, []
                    for s in sorted((s["lo"], s["hi"] + length) for s in [*(sure or ()), *(checked or ())]):
                        if spans and s[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], s[1])
                        else:
                            spans.append([*s])
                    for lo, hi in spans:
                        kept.append(data[at:lo])
                        at = hi
                    kept = b"".join([*kept, data[at:]])
                    rows.append((len(data), len(data) - len(kept), len(spans), kept.decode(errors="ignore") if as_text else kept))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + cols, names=names + ["n_bytes", "n_removed", "n_spans", "kept"])

    done = joined.where(F.col("asks").isNull()).select(*names, "sure", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("checked"))
    rest = joined.where(F.col("asks").isNotNull()).drop("asks").join(found_, "_uid", "left").select(*names, "sure", "checked")
    return done.union(rest).mapInArrow(cut, out_schema)


def _grouped(p: np.ndarray, k: np.ndarray, rows: list[tuple], shift: list[int]) -> list[tuple[int, int, int]]:
    """Runs of hits, which lie in the order of their contexts."""
    if not len(p):
        return []
    cut = np.flatnonzero((np.diff(p) > 1) | (np.diff(k) > 0))
    a, b = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(p) - 1]])
    return [(rows[k[i]][2], int(p[i]) + shift[k[i]], int(p[j]) + shift[k[i]]) for i, j in zip(a, b) if rows[k[i]][1] == 1]
