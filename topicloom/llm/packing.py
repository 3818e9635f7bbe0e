"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, piece int, n_words long, start long, cluster long, group int, bin int, offset long"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size, source, cluster), sizes at most capacity, the larger first.

    Bins lie in order of their residual. The successor search starts at the first bin into which the item fits and goes
    on until the bitmaps of sources and clusters allow it; with none, a new bin opens. No bin gets two items of one source
    or of one cluster.
    """
    left: list[tuple[int, int]] = []  # (residual, bin), sorted
    sources: list[int] = []
    clusters: list[int] = []
    used: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(items)
    bit_s: dict[int, int] = {}
    bit_c: dict[int, int] = {}
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, cluster = items[i]
        s, c = 1 << bit_s.setdefault(source, len(bit_s)), 1 << bit_c.setdefault(cluster, len(bit_c)) if cluster is not None else 0
        k = bisect_left(left, (size, -1))
        while k < len(left) and (sources[left[k][1]] & s or clusters[left[k][1]] & c):
            k += 1
        if k < len(left):
            residual, b = left.pop(k)
        else:
            residual, b = capacity, len(used)
            sources.append(0)
            clusters.append(0)
            used.append(0)
        place[i] = (b, used[b])
        used[b] += size
        sources[b] |= s
        clusters[b] |= c
        insort(left, (residual - size, b))
    return place


def pack(docs: DataFrame, capacity: int = 2048, per_group: int = 4096) -> DataFrame:
    """A row for each piece: doc_id, piece, n_words, start, cluster, group, bin, offset.

    Documents are dealt by hash to groups of about per_group, each packed in one task, so memory is bounded. A document
    above the capacity is cut into pieces of `capacity` words, each alone in its bin, and a rest that is packed like
    others; start is the word at which a piece begins. Empty and null texts are pieces of no words. Conflicts: equal
    source (null is a source), equal text. Equal rows conflict, so each gets its own bin. An empty table gives no rows.
    """
    rows = docs.count()
    groups = max(1, -(-rows // per_group))
    text = F.coalesce(F.col("text"), F.lit(""))
    lean = docs.select("doc_id", F.xxhash64(F.col("source")).alias("source"), F.xxhash64(text).alias("cluster"), common.words("text").alias("size"))
    lean = lean.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)).cast("int"))
    schema = common.pack(SCHEMA)

    def packed(table: pa.Table) -> pa.Table:
        t = table.sort_by([("doc_id", "ascending"), ("cluster", "ascending"), ("size", "ascending")]).to_pydict()
        seen: dict[int, int] = {}
        for c in t["cluster"]:
            seen[c] = seen.get(c, 0) + 1
        items, rows = [], []
        full = 0
        out: dict[str, list] = {f.name: [] for f in schema}

        def put(i, piece, n, start, b, offset):
            for k, v in zip(out, (t["doc_id"][i], piece, n, start, t["cluster"][i], t["group"][i], b, offset)):
                out[k].append(v)

        for i, size in enumerate(t["size"]):
            whole = max(0, size - 1) // capacity
            items.append((size - whole * capacity, t["source"][i], t["cluster"][i] if seen[t["cluster"][i]] > 1 else None))
            rows.append((i, whole))
            full += whole
        at = best_fit(items, capacity)
        k = max((b for b, _ in at), default=-1) + 1
        for (i, whole), (size, _, _), (b, offset) in zip(rows, items, at):
            for p in range(whole):
                put(i, p, capacity, p * capacity, k, 0)
                k += 1
            put(i, whole, size, whole * capacity, b, offset)
        return pa.Table.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("n_words", pa.int64()), ("start", pa.int64()), ("cluster", pa.int64()), ("group", pa.int32()), ("bin", pa.int32()), ("offset", pa.int64())]))

    return lean.groupBy("group").applyInArrow(packed, schema)
