"""Language of each byte and document by a bidirectional gated recurrent network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a window; the recurrence starts anew in each, from both ends, and windows tile the whole text.
STEPS = 96
#: The symbol after the last byte; its update gate is shut, so it leaves the state as it is.
PAD = 256
BATCH = 2048


class BiGru:
    """Bytes to label probabilities. All arrays hold one column per window, so every operation runs along memory.

    Gates z and r and the candidate n of a direction come from one table of 3 * hidden rows, a column per byte.
    z and r are 0.5 + 0.5 * tanh of half their sum; the half is learnt into the weights.
    """

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.labels = list(labels)
        f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.w = [{"x": f(3 * h, 257, s=0.3), "u": f(3 * h, h, s=0.5 / np.sqrt(h))} for _ in range(2)]
        self.v, self.b = f(len(labels), 2 * h, s=0.3), np.zeros((len(labels), 1), np.float32)
        self._shut()

    def _shut(self):
        for w in self.w:
            w["x"][: self.hidden, PAD] = 40.0

    def states(self, x: np.ndarray, d: int, keep: bool = False):
        """[steps, hidden, windows] states of a direction over x [steps, windows]; with keep, the gates too."""
        h, w, n = self.hidden, self.w[d], x.shape[1]
        out = np.empty((len(x), h, n), np.float32)
        kept = []
        state = np.zeros((h, n), np.float32)
        for t in range(len(x)) if d == 0 else reversed(range(len(x))):
            a = w["x"].take(x[t], axis=1)
            g = w["u"] @ state
            zr = a[: 2 * h]
            zr += g[: 2 * h]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = a[2 * h :]
            m = g[2 * h :]
            if keep:
                kept.append((t, zr, m.copy(), state))
            m *= zr[h:]
            c += m
            np.tanh(c, out=c)
            # state = c + z * (state - c)
            new = out[t]
            np.subtract(state, c, out=new)
            new *= zr[:h]
            new += c
            if keep:
                kept[-1] += (c,)
            state = new
        return (out, kept) if keep else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """[steps, labels, windows]."""
        h = self.hidden
        p = np.matmul(self.v[:, :h], self.states(x, 0))
        p += np.matmul(self.v[:, h:], self.states(x, 1))
        p += self.b
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 1) -> BiGru:
        """Backpropagation through time, Adam; x [steps, windows] bytes, y the windows' labels. The loss counts each byte."""
        rng, h = np.random.default_rng(seed), self.hidden
        params = [w[k] for w in self.w for k in ("x", "u")] + [self.v, self.b]
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, total = 0, epochs * -(-x.shape[1] // batch)
        for _ in range(epochs):
            order = rng.permutation(x.shape[1])
            for i in range(0, len(order), batch):
                xs, ys = x[:, order[i : i + batch]], y[order[i : i + batch]]
                n = xs.shape[1]
                grads = [np.zeros_like(p) for p in params]
                both = [self.states(xs, d, keep=True) for d in range(2)]
                p = np.matmul(self.v[:, :h], both[0][0]) + np.matmul(self.v[:, h:], both[1][0]) + self.b
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[:, ys, np.arange(n)] -= 1
                real = xs != PAD
                p *= (real / max(1, real.sum()))[:, None, :].astype(np.float32)
                grads[5] += p.sum(axis=(0, 2))[:, None]
                for d in range(2):
                    states, kept = both[d]
                    v = self.v[:, d * h : d * h + h]
                    grads[4][:, d * h : d * h + h] += np.einsum("tln,thn->lh", p, states)
                    u, gx, gu = self.w[d]["u"], grads[2 * d], grads[2 * d + 1]
                    back = np.zeros((h, n), np.float32)
                    for t, zr, m, before, c in reversed(kept):
                        back = back + v.T @ p[t]
                        z, r = zr[:h], zr[h:]
                        dc = back * (1 - z) * (1 - c * c)
                        # z = 0.5 + 0.5 tanh(s), so dz/ds = 2 z (1 - z)
                        da = np.concatenate([back * (before - c) * 2 * z * (1 - z), dc * m * 2 * r * (1 - r), dc])
                        dg = da.copy()
                        dg[2 * h :] *= r
                        gu += dg @ before.T
                        np.add.at(gx.T, xs[t], da.T)
                        back = back * z + u.T @ dg
                step += 1
                for k, (q, g) in enumerate(zip(params, grads)):
                    np.clip(g, -1, 1, out=g)
                    mean[k] += 0.1 * (g - mean[k])
                    var[k] += 0.01 * (g * g - var[k])
                    q -= (rate * (1 - step / (total + 1))) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-6)
                self._shut()
        return self

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """[documents, labels] mean probability over all bytes, and the number of bytes that get each label."""
        k, lengths = len(self.labels), np.array([len(t) for t in texts], np.int64)
        mass, count = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64)
        per = -(-lengths // STEPS)
        owner = np.repeat(np.arange(len(texts)), per)
        if len(owner):
            buf = np.full(len(owner) * STEPS, PAD, np.int16)
            at = np.concatenate([[0], np.cumsum(per)[:-1]]) * STEPS
            for t, a in zip(texts, at):
                buf[a : a + len(t)] = np.frombuffer(t, np.uint8)
            windows = buf.reshape(-1, STEPS)
            for i in range(0, len(owner), BATCH):
                x, who = np.ascontiguousarray(windows[i : i + BATCH].T), owner[i : i + BATCH]
                p = self.probabilities(x)
                real = x != PAD
                best = p.argmax(axis=1)
                p *= real[:, None, :]
                total = p.sum(axis=0)
                for j in range(k):
                    mass[:, j] += np.bincount(who, total[j], len(texts))
                    count[:, j] += np.bincount(who, ((best == j) & real).sum(axis=0), len(texts)).astype(np.int64)
        return mass / np.maximum(lengths, 1)[:, None], count


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = 500, windows: int = 3) -> list[tuple[str, list[bytes]]]:
    """Training windows of about per_lang documents of each language, chosen by the hash of the id among those not held out.

    The driver gets at most 1.5 * per_lang documents of a language and `windows` pieces of STEPS bytes of each, however
    large the table.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~_held_out() & F.col("doc_id").isNotNull())
    luck = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    keep = F.lit(0)
    for lang in sorted(counts):
        keep = F.when(F.col("lang") == lang, int((1 << 30) * min(1.0, per_lang / counts[lang]))).otherwise(keep)
    place = lambda k: (1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - STEPS + 1, F.lit(1)))).cast("int")
    cut = F.array(*(F.substring(F.col("text"), place(k), F.lit(STEPS)) for k in range(windows)))
    rows = usable.where(luck < keep).select("lang", luck.alias("luck"), F.col("doc_id"), F.array_distinct(cut).alias("pieces")).collect()
    rows.sort(key=lambda r: (r.lang, r.luck, r.doc_id))
    got: dict[str, list] = {}
    for r in rows:
        if len(mine := got.setdefault(r.lang, [])) < 1.5 * per_lang:
            mine.append([p.encode()[:STEPS] for p in r.pieces])
    return [(lang, p) for lang in sorted(got) for p in got[lang]]


def train(docs: DataFrame, per_lang: int = 500, epochs: int = 8) -> BiGru | None:
    """The network for the lang values of docs; None if no row can be learnt from. The same docs give the same network."""
    rows = sample(docs, per_lang)
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    pieces = [(labels.index(lang), p) for lang, doc in rows for p in doc if p]
    x = np.full((STEPS, len(pieces)), PAD, np.int16)
    for i, (_, p) in enumerate(pieces):
        x[: len(p), i] = np.frombuffer(p, np.uint8)
    y = np.array([k for k, _ in pieces])
    # each language weighs alike: the rarer ones' windows repeat
    rng = np.random.default_rng(0)
    most = np.bincount(y).max()
    order = np.concatenate([rng.choice(np.flatnonzero(y == k), most) if (y == k).sum() < most else np.flatnonzero(y == k) for k in range(len(labels))])
    while len(order) * epochs < 4000:
        epochs *= 2
    return BiGru(labels).fit(x[:, order], y[order], epochs)


def predict(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """docs with lang_pred, score, n_bytes, n_agree.

    Every byte of a text gets label probabilities; score is the mean of the winner's over the text, n_agree the number
    of bytes labelled so. `und` with score 0 if text is null or has no letter, or nothing was learnt. Rows are
    independent: repeated rows get equal results, and an empty table gives none. Columns with the results' names are replaced.
    """
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    docs = docs.drop("_ok", "lang_pred", "score", "n_bytes", "n_agree").withColumn("_ok", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType(list(docs.drop("_ok").schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("n_bytes", LongType()).add("n_agree", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                texts = [(t.as_py() or "").encode() for t in batch.column("text")]
                ok = np.array(batch.column("_ok").to_pylist(), dtype=bool)
                lang, score, agree = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                if model is not None:
                    mass, count = model.documents([t if o else b"" for t, o in zip(texts, ok)])
                    best = mass.argmax(axis=1)
                    for i in np.flatnonzero(ok):
                        lang[i], score[i], agree[i] = model.labels[best[i]], min(1.0, mass[i, best[i]]), count[i, best[i]]
                cols = [batch.column(n) for n in batch.schema.names if n != "_ok"]
                extra = [pa.array(lang), pa.array(score), pa.array([len(t) for t in texts], pa.int64()), pa.array(agree)]
                names = [n for n in batch.schema.names if n != "_ok"] + ["lang_pred", "score", "n_bytes", "n_agree"]
                yield pa.RecordBatch.from_arrays(cols + extra, names=names)

    return docs.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose texts hold about `limit` bytes, or one row."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        to = max(at + 1, to)
        yield batch.slice(at, to - at)
        at = to
