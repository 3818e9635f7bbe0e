"""Nearest vectors by randomly rotated one-bit codes with error bounds.

A vector o is stored as the signs of the rotated unit residual P(o - c)/|o - c| to its centre c, packed eight to a byte,
with the residual's norm and the inner product of the residual with its code. For a query's residual q the inner product
<o, q> is estimated as <code, q> over that product; the error stays below BOUND / sqrt(dim - 1) times sqrt(1 - p^2) / p with
overwhelming probability (Gao and Long, RaBitQ, 2024). A row is reranked in double precision if the lower bound of its
distance does not exceed the k-th best distance so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Deviations within which an estimate lies; at 4 a row in some ten thousand would break it.
BOUND = 4.0
CENTRES = 16
#: Rows on which the centres are fitted.
SAMPLE = 4096
#: Queries that are searched for in one pass over the codes.
BLOCK = 4096


class Coder:
    """Rotation and centres; the same for a dimension, seed and sample."""

    def __init__(self, dim: int, sample: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.centres = sample[rng.choice(len(sample), min(CENTRES, len(sample)), replace=False)].astype(np.float64)
        for _ in range(8):
            near = self.nearest(sample)
            for k in range(len(self.centres)):
                if (near == k).any():
                    self.centres[k] = sample[near == k].mean(axis=0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T).argmin(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centre, packed bits, norm, product) of rows."""
        centre = self.nearest(x)
        rest = x - self.centres[centre]
        norm = np.sqrt((rest**2).sum(axis=1))
        turned = (rest @ self.rotation.T) / np.where(norm > 0, norm, 1)[:, None]
        product = np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])
        return centre, np.packbits(turned > 0, axis=1), norm, product


def _valid(df: DataFrame) -> DataFrame:
    """Rows that take part: vectors of the commonest length (then the smaller) whose components are finite and not all zero."""
    x = F.col("embedding")
    fine = df.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0))
    fine = fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    sizes = [(-r.n, r.d) for r in fine.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return fine.where(F.size("x") == (min(sizes)[1] if sizes else 0))


def index(df: DataFrame, seed: int = 11) -> tuple[DataFrame, Coder | None]:
    """Codes of every valid row, a written table: vec_id, x, centre, bits, norm, product. Fitted on the SAMPLE rows of
    smallest id hash."""
    rows = _valid(df)
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("x").collect()
    if not sample:
        return rows.limit(0), None
    data = np.array([r.x for r in sample])
    coder = Coder(data.shape[1], data, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            centre, bits, norm, product = coder.encode(x)
            cols = [b.column("vec_id"), b.column("x"), pa.array(centre.astype(np.int32)), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(norm), pa.array(product)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "x", "centre", "bits", "norm", "product"])

    schema = common.pack("vec_id long, x array<double>, centre int, bits binary, norm double, product double")
    return common.table(rows.mapInArrow(run, schema), "codes"), coder


def _pairs(ids: np.ndarray, x: np.ndarray, centre: np.ndarray, bits: np.ndarray, norm: np.ndarray, product: np.ndarray, coder: Coder, qid: np.ndarray, q: np.ndarray, best: list, k: int) -> None:
    """Puts the batch's rows that may be among a query's k nearest into best: per query (distances, ids), sorted."""
    dim = x.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    safe = np.where(product > 0, product, 1)
    slip = BOUND * np.sqrt(np.maximum(0, 1 - safe**2)) / safe / np.sqrt(max(1, dim - 1))
    for c in np.unique(centre):
        rows = np.flatnonzero(centre == c)
        gap = q - coder.centres[c]
        far = np.sqrt((gap**2).sum(axis=1))
        unit = (gap @ coder.rotation.T) / np.where(far > 0, far, 1)[:, None]
        guess = (signs[rows] @ unit.astype(np.float32).T) / safe[rows, None]
        low = norm[rows, None] ** 2 + far**2 - 2 * norm[rows, None] * far * np.minimum(1, guess + slip[rows, None] + 1e-4)
        for j in range(len(q)):
            d, i = best[j]
            bar = d[-1] ** 2 if len(d) == k else np.inf
            if np.isinf(bar) and len(rows) > 4 * k:  # a first bar from the likeliest rows
                first = rows[np.argpartition(low[:, j], 4 * k)[: 4 * k]]
                d, i = _merge(d, i, first, ids, x, q[j], qid[j], k)
                bar = d[-1] ** 2 if len(d) == k else np.inf
            chosen = rows[low[:, j] <= bar * (1 + 1e-9)]
            best[j] = _merge(d, i, chosen, ids, x, q[j], qid[j], k) if len(chosen) else (d, i)


def _merge(d, i, rows, ids, x, q, qid, k):
    rows = rows[ids[rows] != qid]
    exact = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
    d, i = np.concatenate([d, exact]), np.concatenate([i, ids[rows]])
    order = np.lexsort((i, d))
    d, i = d[order], i[order]
    _, first = np.unique(i, return_index=True)  # an id counts once
    first.sort()
    return d[first][:k], i[first][:k]


def search(codes: DataFrame, coder: Coder | None, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by Euclidean distance, ties to the smaller id.

    Queries (vec_id, x) are taken BLOCK at a time; a block is all that a task holds besides a batch of codes. Every code
    is looked at; each task keeps k rows a query, and these are merged. A query's own id is no candidate. Rows of one id
    count once, by the nearest. Of queries with one id the smallest vector counts. No codes or queries: no rows.
    """
    spark = codes.sparkSession
    schema = common.pack("query_id long, vec_id long, score double")
    found = spark.createDataFrame([], schema)
    one = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = -(-one.count() // BLOCK) if coder else 0
    for b in range(blocks):
        rows = sorted(one.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)) == b).collect())
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in qid]
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    b = whole.slice(at, 2048)
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    get = lambda n, b=b: b.column(n).to_numpy(zero_copy_only=False)
                    for s in range(0, len(qid), 512):
                        part = best[s : s + 512]
                        _pairs(get("vec_id"), x, get("centre"), bits, get("norm"), get("product"), coder, qid[s : s + 512], q[s : s + 512], part, k)
                        best[s : s + 512] = part
            n = [len(d) for d, _ in best]
            cols = [np.repeat(qid, n), np.concatenate([i for _, i in best] or [np.zeros(0, np.int64)]), np.concatenate([d for d, _ in best] or [np.zeros(0)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

        part = codes.mapInArrow(run, schema)
        found = part if b == 0 and blocks == 1 else found.union(common.table(part, "nearest"))
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
