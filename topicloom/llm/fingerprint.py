"""Context-triggered piecewise hashing: chunk signatures at rolling-hash boundaries, compared by edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a signature at most.
LENGTH = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ROLL, _CHUNK = 0x2C9277B5, 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 17)
        base = np.full(n, _CHUNK, np.uint64)
        base[0] = 1
        inverse = np.full(n, pow(_CHUNK, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        _powers[:] = [np.cumprod(base), np.cumprod(inverse)]
    return _powers[0], _powers[1]


def fingerprint(data: bytes) -> str:
    """`block:signature:signature at twice the block`. A boundary follows byte i if the hash of the 7 bytes up to i, plus
    one, is a multiple of the block size 3 * 2^k; k is the least that leaves at most LENGTH chunks."""
    n = len(data)
    if not n:
        return "3::"
    padded = np.zeros(n + 6, np.uint32)
    padded[6:] = np.frombuffer(data, np.uint8)
    roll = padded[6:].copy()
    for j in range(1, 7):
        roll += padded[6 - j : n + 6 - j] * np.uint32(pow(_ROLL, j, 1 << 32))
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    roll |= np.uint32(1 << 31)  # never all ones after the next step's sum
    roll &= np.uint32(0xBFFFFFFF)
    roll += np.uint32(1)
    at = np.flatnonzero(roll % np.uint32(3) == 0)
    v = roll[at]
    level = np.log2((v & (~v + np.uint32(1))).astype(np.float64)).astype(np.int64)
    ends_last = level[-1] if len(at) and at[-1] == n - 1 else -1
    above = np.bincount(level, minlength=1)[::-1].cumsum()[::-1] if len(at) else np.zeros(1, np.int64)
    k = 0
    while k < len(above) and above[k] + (ends_last < k) > LENGTH:
        k += 1
    powers, inverse = _pow(n)
    sums = np.frombuffer(data, np.uint8).astype(np.uint64)
    sums += np.uint64(1)
    sums *= powers[:n]
    sums = sums.cumsum()

    def signature(k: int) -> str:
        ends = at[level >= k]
        if not len(ends) or ends[-1] != n - 1:
            ends = np.append(ends, n - 1)
        total = sums[ends]
        starts = np.concatenate([[0], ends[:-1] + 1])
        total[1:] -= sums[ends[:-1]]
        total *= inverse[starts]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        return "".join(LETTERS[i] for i in (total >> np.uint64(58)).tolist())

    return f"{3 << k}:{signature(k)}:{signature(k + 1)}"


def distance(a: str, b: str) -> int:
    """Edit distance (insertions, deletions, substitutions), a column of the table per step as bits of one integer."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        score += bool(up & last) - bool(down & last)
        up = (up << 1 | 1) & full
        plus = (down << 1 | ~(diagonal | up)) & full
        minus = up & diagonal
    return score


def _near(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short = min(len(a), len(b), 4)
    if not short or {a[i : i + short] for i in range(len(a) - short + 1)}.isdisjoint(b[i : i + short] for i in range(len(b) - short + 1)):
        return 0.0
    return 1 - distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: of the signatures at equal block sizes, 1 less the edit distance over the longer length; 1 if the
    fingerprints are equal, 0 if no block size agrees or no run of four letters is common."""
    if a == b:
        return 1.0
    m, a1, a2 = a.split(":")
    n, b1, b2 = b.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_near(a1, b1), _near(a2, b2))
    if m == 2 * n:
        return _near(a1, b2)
    if n == 2 * m:
        return _near(a2, b1)
    return 0.0


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """SCHEMA for each row: its fingerprint, and those of its edited text and of the next row by descending doc_id.

    Rows of equal id follow each other by the hash of their text; null ids come last. The next of the last row is the
    first, of a single row itself. A null text counts as empty. An empty table gives no rows. Other columns are ignored.

    Rows are dealt by ranges of doc_id, and each range also gets the first row of the one that follows, so each
    text moves once and a task holds two rows at a time.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lean = lean.withColumn("h", F.xxhash64("text"))
    cuts = lean.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0))
    lean = lean.withColumn("bucket", bucket)
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("f"), "doc_id", "h")).alias("top")
    heads = lean.groupBy("bucket").agg(top).collect()  # a row for each range
    heads.sort(key=lambda r: -r.bucket)
    follow = [(r.top.doc_id, r.top.h, heads[i - 1].bucket) for i, r in enumerate(heads)]  # i = 0: the first follows the last
    told = spark.createDataFrame(follow, "head long, hh long, to int")
    more = lean.join(F.broadcast(told), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("hh")))
    rows = lean.withColumn("extra", F.lit(0)).unionByName(more.select("doc_id", "text", "h", F.col("to").alias("bucket"), F.lit(1).alias("extra")))
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None  # (bucket, doc_id, text, fingerprint, extra)
        for batch in batches:
            cols = [batch.column(c) for c in ("bucket", "doc_id", "text", "extra")]
            for i in range(batch.num_rows):
                b, doc, text, extra = (c[i].as_py() for c in cols)
                if last and last[0] == b and last[4] and extra:
                    continue  # only the first of rows with the head's id
                now = (b, doc, text, fingerprint(text.encode()), extra)
                if last and last[0] == b and not last[4]:
                    old, half = last[2], len(last[2]) // 2
                    edited = (old[: len(old) - half] + text[:half]).encode()
                    mark = fingerprint(edited)
                    out.append((last[1], len(old), hashlib.sha256(edited).hexdigest(), last[3], mark, likeness(last[3], mark), likeness(last[3], now[3])))
                last = now
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                    out = []
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, common.pack(SCHEMA))
