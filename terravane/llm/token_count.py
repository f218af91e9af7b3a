"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from terravane.llm.common import Texts, batches, id_and_text, trim

#: Fixed value: the pre-tokenizer's pattern, white space written as the Unicode property it means there.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same pattern for the standard library, which is faster but has other classes: only for texts of characters on which they agree.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
AGREED = re.compile("[\x00-\x1b\x20-\x7e\u00c0-\u024f\u2013\u2014\u2018-\u201d\u2026]*")
#: Pre-tokens that a worker remembers of late, and as many from before.
REMEMBERED = 250_000
NEVER = np.int32(2**31 - 1)
#: Slots of the table of pairs.
SLOTS = 1 << 18


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in own else next(spare)) for b in range(256)}


def pre_tokens(text: str) -> list[str]:
    return (PLAIN if AGREED.fullmatch(text) else PATTERN).findall(text)


class Memory:
    """What has been made of pre-tokens, in two generations, so that frequent ones stay when it is full."""

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.late: dict = {}
        self.before: dict = {}

    def clear(self) -> None:
        self.late, self.before = {}, {}

    def of(self, parts: list[list[str]], make) -> dict:
        """A dict with all the pre-tokens; make: list of new ones -> what is made of each."""
        if len(self.late) > self.most:
            self.late, self.before = {}, self.late
        new = set().union(*parts).difference(self.late)
        again = new & self.before.keys()
        for x in again:
            self.late[x] = self.before[x]
        rest = list(new - again)
        self.late.update(zip(rest, make(rest), strict=True))
        return self.late


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


class RankMerger:
    """Counts the symbols that are left of byte strings when no merge applies any more."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.size = max(vocabulary.values()) + 1
        self.bytes = np.array([vocabulary[c] for _, c in sorted(byte_letters().items())], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        into = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys, self.rank, self.into = keys[self.order], self.order.astype(np.int32), into
        # each slot has the key of the lowest rank that falls there; others of a shared slot are searched for
        slot = _slot(keys)
        self.slot_key, self.slot_rank = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NEVER, np.int32)
        self.slot_key[slot[::-1]], self.slot_rank[slot[::-1]] = keys[::-1], np.arange(len(keys), dtype=np.int32)[::-1]
        self.shared = np.bincount(slot, minlength=SLOTS) > 1

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or NEVER."""
        key = left * self.size + right
        slot = _slot(key)
        rank = np.where(self.slot_key[slot] == key, self.slot_rank[slot], NEVER)
        again = np.flatnonzero(self.shared[slot] & (rank == NEVER))
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, key[again]), len(self.keys) - 1)
            known = self.keys[at] == key[again]
            rank[again[known]] = self.rank[at[known]]
        return rank

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        out = np.zeros(len(pieces), np.int64)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        seq = np.repeat(np.arange(len(pieces)), lens)
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        # the rank of each symbol with the next one; after a round only those beside a merge are looked up again
        rank = np.full(len(ids), NEVER, np.int32)
        look = np.ones(len(ids), bool)
        while len(ids):
            new = seq[1:] != seq[:-1]
            look = np.flatnonzero(look)
            rank[look] = NEVER
            look = look[look < len(ids) - 1]
            look = look[~new[look]]
            rank[look] = self.ranks(ids[look], ids[look + 1])
            first = np.flatnonzero(np.r_[True, new])
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(ids)))
            done = least == NEVER
            out[seq[first[done]]] = sizes[done]
            own = np.repeat(least, sizes)
            hit = np.flatnonzero((rank == own) & (rank != NEVER))
            look = np.zeros(len(ids), bool)
            if len(hit):
                # of overlapping pairs of one symbol, every second one merges, from the left
                start = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
                nth = np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))
                hit = hit[nth % 2 == 0]
                ids[hit] = self.into[rank[hit]]
                look[hit] = True
            keep = np.repeat(~done, sizes)
            keep[hit + 1] = False
            ids, seq, rank, look = ids[keep], seq[keep], rank[keep], look[keep]
            look[:-1] |= look[1:].copy()
        return out


@lru_cache(maxsize=2)
def _load(path: str):
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    split = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    return RankMerger(spec["model"]["vocab"], spec["model"]["merges"]), split, Memory()


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text; a special token's string inside a text is one token, as the library has it."""
    merger, split, memory = _load(path)
    parts, extra = [], []
    for t in texts:
        if split is not None and (n := len(split.findall(t))):
            extra.append(n)
            parts.append([x for p in split.split(t) for x in pre_tokens(p)])
        else:
            extra.append(0)
            parts.append(pre_tokens(t))
    seen = memory.of(parts, lambda new: merger.counts([x.encode() for x in new]).tolist())
    return [n + sum(map(seen.__getitem__, p)) for n, p in zip(extra, parts, strict=True)]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows
    come back as often as they occur; no other column is read. path: a byte-level BPE file
    that every executor has (default: byte_bpe_50k.json of public_tokenizers).
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spec = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]

    @batches(spec)
    def count(batch):
        texts = Texts(batch.column(1))
        column = batch.column(1).fill_null("")
        n: list[int] = []
        for i, j in texts.pieces(1 << 20):
            n += count_tokens(column.slice(i, j - i).to_pylist(), path)
        counted = np.array(n, np.int64)
        return [batch.column(0), texts.ends - texts.starts, counted, counted > limit]

    def run(it):
        try:
            yield from count(it)
        finally:  # workers stay, idle, beside the executor
            _load(path)[2].clear()
            trim()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
