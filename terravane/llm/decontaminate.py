"""Benchmark decontamination: a prefix-filtered join of item-sized windows with whole documents.

A window (an item's run of `window` words; the whole of a shorter item) is contained in a document
only if all of its shingles are, so one of them is prefix enough: the rarest over all documents. Documents probe with their
shingles, the shingle's place in the window and the lengths bound where the window can lie, and the words themselves decide.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Scratch, Texts, batches, column, filtered, id_and_text, prepare
from terravane.llm.words import MIX, Words, shingles

#: Bytes of benchmark text that one broadcast index is made of (some 15 times that in memory); a larger benchmark is joined in blocks.
BLOCK = 4 << 20
SHINGLE = 5
_BITS = 20
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


@dataclass
class Shingles:
    """Sorted shingle hashes of one size, with a bitmap that says which documents' shingles to look up."""

    size: int
    keys: np.ndarray

    def __post_init__(self):
        self._mark = np.zeros(1 << _BITS, bool)
        self._mark[(self.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that are keys, and which key."""
        at = np.flatnonzero(self._mark[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[k] == hashes[at]
        return at[same], k[same]


class Benchmark:
    """Windows of a block of items: where their words lie in the block's words, the items that have them, and their rarest shingles.

    Some 40 bytes a word of the block and 40 a window, wherever the text comes from.
    """

    def __init__(self, names: list[str], texts: Texts, window: int):
        self.names, rank = np.unique(np.array(names, object), return_inverse=True)
        words = Words(texts.data, texts.bounds, _WORD)
        self.hash, self.length, self.letters, self.place = words.hash, words.length, words.letters, words.place
        n = np.diff(words.first)
        each = np.where(n > 0, n - np.minimum(n, window) + 1, 0)
        item = np.repeat(np.arange(len(n)), each)
        start = np.repeat(words.first[:-1] - (np.cumsum(each) - each), each) + np.arange(len(item))
        size = np.minimum(n, window)[item]
        # equal windows are one: two hashes of all their words
        keys = [size.astype(np.uint64), size.astype(np.uint64)]
        with np.errstate(over="ignore"):
            for j in range(int(size.max(initial=0))):
                there = np.minimum(start + j, len(self.hash) - 1)
                for k in range(2):
                    keys[k] = np.where(j < size, (keys[k] ^ self.hash[there] ^ self.length[there].astype(np.uint64)) * MIX[2 * k + 1] + MIX[2 * k + 2], keys[k])
        by = np.lexsort((rank[item], *keys))
        new = np.r_[True, (keys[0][by][1:] != keys[0][by][:-1]) | (keys[1][by][1:] != keys[1][by][:-1])] if len(by) else np.zeros(0, bool)
        self.start, self.size = start[by][new], size[by][new]
        of, number = rank[item][by], np.cumsum(new) - 1
        once = np.r_[True, (number[1:] != number[:-1]) | (of[1:] != of[:-1])] if len(by) else new
        self.item_of, self.item_at = of[once], np.searchsorted(number[once], np.arange(len(self.start) + 1))
        self.shingle_size = np.minimum(self.size, SHINGLE)
        self.index: list = []

    def _hashes(self, size: int) -> np.ndarray:
        return shingles(self.hash, size)

    def all_shingles(self) -> list[Shingles]:
        """The distinct shingles of all windows, by their size."""
        found = []
        for size in np.unique(self.shingle_size).tolist():
            own = self.shingle_size == size
            edge = np.zeros(len(self.hash) + 2, np.int64)
            np.add.at(edge, self.start[own], 1)
            np.add.at(edge, self.start[own] + self.size[own] - size + 1, -1)
            found.append(Shingles(size, np.unique(self._hashes(size)[np.flatnonzero(np.cumsum(edge) > 0)])))
        return found

    def order(self, shingles: list[Shingles], counts: list[np.ndarray]) -> None:
        """Index each window by its rarest shingle, by the counts of the keys; ties go to the smaller hash, then the earlier place."""
        self.index = []
        for s, n in zip(shingles, counts, strict=True):
            hashes = self._hashes(s.size)
            windows = np.flatnonzero(self.shingle_size == s.size)
            start, last = self.start[windows], self.size[windows] - s.size
            best_n, best_h, place = np.full(len(windows), -1, np.int64), np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.int64)
            for j in range(int(last.max(initial=-1)) + 1):
                i = np.flatnonzero(j <= last)
                h = hashes[start[i] + j]
                c = n[np.searchsorted(s.keys, h)]
                better = (best_n[i] < 0) | (c < best_n[i]) | ((c == best_n[i]) & (h < best_h[i]))
                i, h, c = i[better], h[better], c[better]
                best_n[i], best_h[i], place[i] = c, h, j
            by = np.argsort(best_h, kind="stable")
            keys, first = np.unique(best_h[by], return_index=True)
            self.index.append((Shingles(s.size, keys), np.r_[first, len(by)], windows[by], place[by]))

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence."""
        at_all, win_all = [], []
        for shingles, first, windows, places in self.index:
            at, k = shingles.find(words.shingles(shingles.size))
            each = first[k + 1] - first[k]
            which = np.repeat(first[k], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            win = windows[which]
            start = np.repeat(at, each) - places[which]
            # positional and length bounds: the window lies within the row that has the shingle
            row = np.searchsorted(words.first, np.repeat(at, each), "right") - 1
            ok = (start >= words.first[row]) & (start + self.size[win] <= words.first[row + 1])
            start, win = start[ok], win[ok]
            for j in range(int(self.size.max(initial=0))):
                there, own = np.minimum(start + j, len(words.hash) - 1), np.minimum(self.start[win] + j, len(self.hash) - 1)
                ok = (j >= self.size[win]) | ((words.hash[there] == self.hash[own]) & (words.length[there] == self.length[own]))
                start, win = start[ok], win[ok]
            if len(start):  # the hashes agree: compare the letters
                a, b = words.place[start], self.place[self.start[win]]
                n = self.place[self.start[win] + self.size[win]] - b
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                same = words.letters[np.repeat(a, n) + step] == self.letters[np.repeat(b, n) + step]
                ok = np.logical_and.reduceat(same, np.cumsum(n) - n)
                at_all.append(start[ok])
                win_all.append(win[ok])
        if not at_all:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at_all), np.concatenate(win_all)


def _count_shingles(docs: DataFrame, shingles: list[Shingles]) -> list[np.ndarray]:
    """How often each of these shingles occurs in all documents; as many sums as the block has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)
    schema = pa.schema([("size", pa.int32()), ("k", pa.int64()), ("n", pa.int64())])

    def count(it):
        total = [np.zeros(len(s.keys), np.int64) for s in shared.value]
        for batch in it:
            texts = Texts(batch.column(0))
            for i, j in texts.pieces(1 << 19):
                bounds = texts.bounds[i : j + 1] - texts.bounds[i]
                words = Words(texts.data[texts.bounds[i] : texts.bounds[j]], bounds, _WORD)
                for t, s in zip(total, shared.value, strict=True):
                    at, k = s.find(words.shingles(s.size))
                    row = np.searchsorted(words.first, at, "right") - 1
                    t += np.bincount(k[at + s.size <= words.first[row + 1]], minlength=len(t))
        for t, s in zip(total, shared.value, strict=True):
            k = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s.size, np.int32)), pa.array(k), pa.array(t[k])], schema=schema)

    sums = docs.select("text").mapInArrow(count, "size int, k long, n long").groupBy("size", "k").agg(F.sum("n").alias("n"))
    out, found = [np.zeros(len(s.keys), np.int64) for s in shingles], sums.toArrow()
    size, k, n = (found.column(i).to_numpy() for i in range(3))
    for s, total in zip(shingles, out, strict=True):
        total[k[size == s.size]] = n[size == s.size]
    shared.destroy()
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of an item; items are those with an
    occurring window, hashed as their ids, sorted as strings and joined by commas. Null and
    empty texts have no words; items without words match nothing, an item without an id counts as the empty id;
    repeated rows come back as often as they occur; other columns are not read.

    The index of the benchmark is broadcast in blocks of about `block` bytes of its text: its size is
    asked for first, and a benchmark of more than one block is joined block after block, hits being carried along.
    """
    spark = prepare(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block)
    flow = rows.select("doc_id", "text", F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    with Scratch(spark, "decontaminate") as scratch:
        before = None
        for k, items in enumerate(blocks):
            shared, last = spark.sparkContext.broadcast(_indexed(items, rows, window)), k == len(blocks) - 1
            flow = flow.mapInArrow(_join(shared, last), _LAST if last else "doc_id long, text string, hits binary, items array<string>")
            if not last:
                flow = scratch.written(flow, "block", keep=k == len(blocks) - 2)
                shared.destroy()
                if before is not None:
                    scratch.drop(before)
                before = flow
    return flow


def without_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, all columns as they are.

    Null texts have no words and stay, as do rows without an id, which is not read; repeated rows stay or go together. A
    benchmark of several blocks takes out the rows block after block.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(column(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block)
    with Scratch(spark, "decontaminate") as scratch:
        before = None
        for k, items in enumerate(blocks):
            shared = spark.sparkContext.broadcast(_indexed(items, rows, window))
            docs = filtered(docs, text_col, _clean(shared))
            if k < len(blocks) - 1:
                docs = scratch.written(docs, "block", keep=k == len(blocks) - 2)
                shared.destroy()
                if before is not None:
                    scratch.drop(before)
                before = docs
    return docs


def _clean(shared):
    def keep(texts: Texts) -> np.ndarray:
        out = np.ones(len(texts), bool)
        for i, j in texts.pieces(1 << 19):
            words = Words(texts.data[texts.bounds[i] : texts.bounds[j]], texts.bounds[i : j + 1] - texts.bounds[i], _WORD)
            if len(words.hash) and shared.value.index:
                start, _ = shared.value.matches(words)
                out[i + np.searchsorted(words.first, start, "right") - 1] = False
        return out

    return keep


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block: int) -> list[DataFrame]:
    """(item, text) in blocks of about `block` bytes of text."""
    items = benchmark.select(F.coalesce(column(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(column(item_text_col).cast("string"), F.lit("")).alias("text"))
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]


def _indexed(items: DataFrame, rows: DataFrame, window: int) -> Benchmark:
    """A block's windows, each indexed by the shingle that is rarest in all of rows."""
    found = items.toArrow()
    index = Benchmark(found.column(0).to_pylist(), Texts(found.column(1)), window)
    keys = index.all_shingles()
    if keys:
        index.order(keys, _count_shingles(rows, keys))
    return index


_LAST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _join(shared, last: bool):
    spec = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
    if not last:
        spec = [("doc_id", pa.int64()), ("text", pa.string()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))]

    @batches(spec)
    def join(batch):
        index, texts = shared.value, Texts(batch.column(1))
        n = len(texts)
        n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
        before, names = batch.column(2).to_pylist(), [set(x or ()) for x in batch.column(3).to_pylist()]
        after: list = [None] * n
        for i, j in texts.pieces(1 << 19):
            words = Words(texts.data[texts.bounds[i] : texts.bounds[j]], texts.bounds[i : j + 1] - texts.bounds[i], _WORD)
            total = len(words.hash)
            n_words[i:j] = np.diff(words.first)
            edge = np.zeros(total + 1, np.int64)
            if total and index.index:
                start, win = index.matches(words)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.size[win], -1)
                if len(start):
                    row = np.searchsorted(words.first, start, "right") - 1
                    pair = np.unique(row * len(index.size) + win)
                    row, win = pair // len(index.size), pair % len(index.size)
                    each = index.item_at[win + 1] - index.item_at[win]
                    which = np.repeat(index.item_at[win], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    pair = np.unique(np.repeat(row, each) * len(index.names) + index.item_of[which])
                    for r, k in zip((pair // len(index.names)).tolist(), (pair % len(index.names)).tolist(), strict=True):
                        names[i + r].add(index.names[k])
            hit = np.cumsum(edge)[:-1] > 0
            for r in range(i, j):
                if before[r]:
                    hit[words.first[r - i] : words.first[r - i + 1]] |= np.unpackbits(np.frombuffer(before[r], np.uint8), count=int(n_words[r])).astype(bool)
            n_hit[i:j] = np.diff(np.r_[0, np.cumsum(hit)][words.first])
            if not last:
                for r in np.flatnonzero(n_hit[i:j]) + i:
                    after[r] = np.packbits(hit[words.first[r - i] : words.first[r - i + 1]]).tobytes()
        if not last:
            return [batch.column(0), batch.column(1), after, [sorted(s) if s else None for s in names]]
        none = hashlib.sha256(b"").hexdigest()
        digests = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() if s else none for s in names]
        return [batch.column(0), n_words, n_hit, [len(s) for s in names], digests, n_hit > 0]

    return join
