"""Token ids in Re-Pair compressed shards with random access."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import slices

END = 2
#: Ids of a shard, which has one grammar; a document is never split, so a shard may exceed it by one document.
SHARD = 1 << 21
#: Bytes of text that are encoded at once.
BATCH = 1 << 24
#: Pieces of text that a worker remembers the ids of, and the longest that it remembers, in bytes.
PIECES, LONGEST = 2_000_000, 64
_MULT = np.uint64(0x9E3779B97F4A7C15)


def repair(ids: np.ndarray, first: int, least: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """(symbols, rules): rounds replace frequent pairs by nonterminals, numbered on from `first`, until none occurs `least` times.

    rules has an array [n, 2] of symbols a round. In a round every pair that occurs often enough becomes a rule. Where
    occurrences overlap, the pair that occurs more often has the place in the first round, and in a later one where it is
    the only way on; else every second one from the left. A pair left with too few places waits.
    A pair with END is never replaced, so no rule reaches over the end of a document.
    """
    rules: list[np.ndarray] = []
    seq = np.append(ids, END).astype(np.uint32)  # a list linked by after and before, with an END behind the last symbol
    after, before = np.arange(1, len(seq) + 1, dtype=np.int32), np.arange(-1, len(seq) - 1, dtype=np.int32)
    # open_[i]: the pair that starts at i may occur often enough. A pair that does not never will, unless a symbol changes
    open_ = np.ones(len(seq), bool)
    open_[-1], gone = False, 0
    while True:
        if gone * 2 > len(seq):
            seq, open_ = seq[live := before != -2], open_[live]
            after, before, gone = np.arange(1, len(seq) + 1, dtype=np.int32), np.arange(-1, len(seq) - 1, dtype=np.int32), 0
        at = np.flatnonzero(open_)
        open_[at] = False
        a, b = seq[at], seq[after[at]]
        free = (a != END) & (b != END)
        if len(same := np.flatnonzero((a == b) & free)):  # of equal symbols in a row every second pair counts
            odd = same[_place_in_run(at[same], after) % 2 == 1]
            open_[at[odd]] = True
            free[odd] = False
        key = a.astype(np.uint64) << np.uint64(32) | b
        at, key = at[free], key[free]
        bits = max(10, len(key).bit_length())
        slot = key * _MULT >> np.uint64(64 - bits)
        kinds, count = np.unique(key, return_counts=True)
        kinds, count = kinds[count >= least], count[count >= least]
        if not len(kinds):
            break
        kinds = kinds[np.argsort(count, kind="stable")]  # a kind's number is its rank; the highest has its slot
        table = np.full(1 << bits, -1, np.int32)
        home = kinds * _MULT >> np.uint64(64 - bits)
        table[home] = np.arange(len(kinds), dtype=np.int32)
        rank = table[slot]
        found = kinds[rank] == key
        if len(lost := home[table[home] != np.arange(len(kinds))]):  # kinds that wait, as another has their slot
            other = at[~found]
            open_[other[np.isin(slot[~found], lost)]] = True
        at, rank = at[found], rank[found]
        open_[at] = True
        for by_rank in (False, True) if rules else (True,):
            if by_rank:
                beside, win = after[at[:-1]] == at[1:], np.ones(len(at), bool)
                win[:-1] &= ~(beside & (rank[1:] > rank[:-1]))
                win[1:] &= ~(beside & (rank[:-1] > rank[1:]))
            else:
                win = _place_in_run(at, after) % 2 == 0
            good = np.bincount(rank[win], minlength=len(kinds)) >= least
            if good.any():
                break
        else:
            break
        win &= good[rank]
        at, rank = at[win], rank[win]
        second = after[at]
        seq[at] = first + (np.cumsum(good) - 1)[rank]
        after[at] = after[second]
        before[after[at]] = at
        before[second], open_[second] = -2, False  # taken out of the list
        gone += len(at)
        ahead = before[at]
        open_[ahead[ahead >= 0]] = True
        kinds = kinds[good]
        rules.append(np.stack([kinds >> np.uint64(32), kinds & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        first += len(kinds)
    return seq[before != -2][:-1], rules


def _place_in_run(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending places in the list: how many neighbours come before each without a gap."""
    start = np.ones(len(at), bool)
    start[1:] = after[at[:-1]] != at[1:]
    number = np.arange(len(at), dtype=np.int32)
    return number - np.maximum.accumulate(np.where(start, number, 0))


def lengths(rules: list[np.ndarray], first: int) -> np.ndarray:
    """Ids that each rule stands for."""
    out = np.zeros(sum(len(r) for r in rules), np.uint32)
    done = 0
    for r in rules:
        a = r.astype(np.int64) - first
        out[done : done + len(r)] = np.where(a >= 0, out[np.maximum(a, 0)], 1).sum(axis=1)
        done += len(r)
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, held: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for; held: ids of each rule. Each step opens all symbols that stand for others."""
    size = np.concatenate([np.ones(first, np.int64), held])
    ends = np.cumsum(size[symbols])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    at = ends - size[symbols]
    while len(symbols):
        inner = symbols >= first
        out[at[~inner]] = symbols[~inner]
        at, pair = at[inner], rules[symbols[inner] - first]
        symbols = np.concatenate([pair[:, 0], pair[:, 1]])
        at = np.concatenate([at, at + size[pair[:, 0]]])
    return out


def _packed(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _unpacked(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u4")


def compressed(ids: np.ndarray, first: int) -> dict:
    """The fields of a record that hold ids: width in bytes of a symbol, first, rules, expansions, symbols."""
    symbols, rules = repair(ids, first)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    width = 3 if first + len(flat) < 1 << 24 else 4
    return {"width": width, "first": first, "rules": _packed(flat.reshape(-1), width), "expansions": lengths(rules, first).astype("<u4").tobytes(), "symbols": _packed(symbols, width)}


class Shard:
    """A record of a file: decodes any stretch of ids by expanding only the symbols that it touches."""

    def __init__(self, row: dict):
        self.first = row["first"]
        self.rules = _unpacked(row["rules"], row["width"]).reshape(-1, 2)
        self.symbols = _unpacked(row["symbols"], row["width"])
        self.held = np.frombuffer(row["expansions"], "<u4")
        size = np.ones(len(self.symbols), np.int64)
        inner = self.symbols >= self.first
        size[inner] = self.held[self.symbols[inner] - self.first]
        self.ends = np.cumsum(size)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = int(self.ends[-1]) if stop is None and len(self.ends) else stop or 0
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.ends, stop)
        out = expand(self.symbols[a : b + 1], self.rules, self.held, self.first)
        skip = start - (int(self.ends[a - 1]) if a else 0)
        return out[skip : skip + stop - start]


def _inside(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of strings or binaries without nulls; the offsets start at 0."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


class Encoder:
    """Ids of whole texts, as the library's plain call gives them.

    If the file's pre-tokenizer is the usual one of byte-level BPE, it always splits before white space that follows
    other characters, and about a lone line end or tab. So texts are cut there; pieces are told apart by Arrow's
    dictionary, each is encoded once and then comes from memory. Texts with added tokens or white space beyond ASCII are
    encoded whole, and so is everything under another pre-tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        split = told.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.usual = usual and not any(told.get(k) for k in ("normalizer", "truncation", "padding")) and not any(len(t.split()) != 1 or t != t.strip() for t in self.added)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a space
        self.leads[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.known = pa.array([], pa.binary())  # the ids of piece i: sizes[i] of flat, from starts[i] on
        self.flat, self.filled = np.empty(1 << 20, np.uint32), 0
        self.starts, self.sizes, self.again = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32), np.zeros(1 << 16, bool)

    def _forget(self) -> None:
        """Keeps the pieces that several batches had, if they leave half of the room."""
        at = np.flatnonzero(self.again[: len(self.known)])
        at = at if len(at) <= PIECES // 2 else at[:0]
        ids, size = self._gather(at), self.sizes[at]
        self.known, self.filled = self.known.take(pa.array(at)), 0
        self.again[:] = False
        self._learn(ids, size, 0)

    def _gather(self, order: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after the other."""
        size = self.sizes[order]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.starts[order] - ends + size, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def _many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces that begin with their only white space, a space: encoded some hundred
        at once and told apart by the ids that begin with a space."""
        offsets, data = _inside(pieces)
        cuts = [*offsets[::256].tolist(), int(offsets[-1])]
        ids = np.concatenate([np.array(x, np.uint32) for x in self._many([data[i:j].tobytes().decode() for i, j in zip(cuts, cuts[1:]) if i < j])])
        at = np.flatnonzero(self.leads[ids])
        if len(at) != len(pieces) or at[0]:
            return self._each(pieces)
        return ids, np.diff(np.append(at, len(ids)))

    def _each(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = self._many([p.decode() for p in pieces.to_pylist()])
        return np.concatenate([np.array(x, np.uint32) for x in got]), np.array([len(x) for x in got], np.int32)

    def _learn(self, ids: np.ndarray, sizes: np.ndarray, first: int) -> None:
        """Notes the ids of pieces first, first + 1 and so on."""
        while len(self.flat) < self.filled + len(ids):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.starts) < first + len(sizes):
            self.starts, self.sizes, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.again))
        self.flat[self.filled : self.filled + len(ids)] = ids
        ends = self.filled + np.cumsum(sizes)
        self.starts[first : first + len(sizes)], self.sizes[first : first + len(sizes)] = ends - sizes, sizes
        self.filled += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). texts: strings without nulls."""
        offsets, data = _inside(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        if self.usual:
            blank = np.concatenate([[False], _BLANK[data], [False]])
            after = blank[1:-1] & ~blank[:-2]
            cut[:-1] = after
            cut[1:] |= after & ~blank[2:] & (data != 32)
            for i in np.flatnonzero(self._whole(texts, data, offsets)):
                cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1]] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        kinds = pieces.dictionary
        if len(self.known) + len(kinds) > PIECES:
            self._forget()
        number = pc.fill_null(pc.index_in(kinds, value_set=self.known), -1).to_numpy().copy()
        self.again[number[number >= 0]] = True
        new = np.flatnonzero(number < 0)
        at, inner = _inside(kinds)
        long = np.diff(at)[new] > LONGEST
        word = ~long & (inner[at[new]] == 32) & ~_BLANK[inner[np.minimum(at[new] + 1, len(inner) - 1)]] & (np.diff(at)[new] > 1) & self.usual
        filled = None
        for which, encode in ((word, self._words), (~word & ~long, self._each), (long, self._each)):
            if which is long:
                filled, known = self.filled, self.known  # what is long is not remembered
            if which.any():
                some = kinds.take(pa.array(new[which]))
                self._learn(*encode(some), len(self.known))
                number[new[which]] = np.arange(len(self.known), len(self.known) + len(some))
                self.known = pa.concat_arrays([self.known, some])
        order = number[pieces.indices.to_numpy()]
        ids, ends = self._gather(order), np.cumsum(self.sizes[order])
        self.filled, self.known = filled, known
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)

    def _whole(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are encoded whole."""
        whole = np.zeros(len(texts), bool)
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        at = np.flatnonzero((data[:-1] == 0xC2) | (data[:-1] >= 0xE1) & (data[:-1] <= 0xE3)) if len(data) > 1 else np.zeros(0, np.int64)
        one, two, three = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        space = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80)
        space |= (one == 0xE2) & ((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F))
        space |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
        whole[np.searchsorted(offsets, at[space], side="right") - 1] = True
        return whole


_encoders: dict[str, Encoder] = {}

RECORD = "file int, shard int, file_start long, n_ids long, doc_ids array<long>, n_tokens array<long>, width int, first int, rules binary, expansions binary, symbols binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def write(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes docs by ascending doc_id and writes one file per range of ids to the shared folder; returns the records.

    The format is a Parquet file per range with a record per shard of about SHARD ids: doc ids and their numbers of ids,
    the shard's Re-Pair rules and how many ids each stands for, and the symbols, three bytes each, four if they are too
    many. file_start counts the ids of the file before the shard. Each document ends with END; a null text is empty. Null
    doc_ids come first, rows of one id by the hash of their text. An empty table gives no records. A very long text is one
    document of one shard. Other columns are ignored. Files are written by Spark's committer, so a task that is lost is
    written again. A task holds one shard at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(common.partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        first = encoder.tokenizer.get_vocab_size()
        docs_, ids, sizes, n, before, number = [], [], [], 0, 0, 0

        def record() -> pa.RecordBatch:
            nonlocal docs_, ids, sizes, n, before, number
            held = compressed(np.concatenate(ids), first)
            row = {"file": file, "shard": number, "file_start": before, "n_ids": n, "doc_ids": np.concatenate(docs_).tolist(), "n_tokens": np.concatenate(sizes)} | held
            before, number = before + n, number + 1
            docs_, ids, sizes, n = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), _KINDS)], names=list(row))

        for whole in batches:
            for b in slices(whole, BATCH):
                got, size = encoder.encode(b.column("text"))
                got = np.insert(got, np.cumsum(size), END)
                size += 1
                doc, ends, at = np.array(b.column("doc_id").to_pylist(), object), np.cumsum(size), 0
                while at < len(size):  # documents up to the one that fills the shard
                    base = int(ends[at - 1]) if at else 0
                    to = min(len(size), int(np.searchsorted(ends, base + SHARD - n)) + 1)
                    docs_.append(doc[at:to])
                    sizes.append(size[at:to])
                    ids.append(got[base : int(ends[to - 1])])
                    n += len(ids[-1])
                    at = to
                    if n >= SHARD:
                        yield record()
        if docs_:
            yield record()

    return common.table(rows.mapInArrow(run, common.pack(RECORD)), "token-ids")


def documents(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file, shard of each document, read back from the records' files.

    start is the number of ids before the document: of earlier files (their totals, a row each, come to the driver),
    of earlier shards of its file, and of the shard's documents before it.
    """
    totals = {r.file: r.n for r in records.groupBy("file").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for s in sorted(totals):
        base[s], at = at, at + totals[s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(n)[k].as_py() for n in b.schema.names if n not in ("doc_ids", "n_tokens")}
                size = b.column("n_tokens")[k].values.to_numpy()
                ends = np.cumsum(size)
                data = memoryview(Shard(row).ids().astype("<u4"))
                crc = [zlib.crc32(data[e - s : e]) for s, e in zip(size.tolist(), ends.tolist())]
                start = base[row["file"]] + row["file_start"] + ends - size
                cols = [b.column("doc_ids")[k].values, pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array([row["file"]] * len(crc), pa.int32()), pa.array([row["shard"]] * len(crc), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "shard"])

    return records.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file int, shard int")
