"""Rank-synchronous byte-pair merging of many short sequences in flat numpy arrays."""

from __future__ import annotations

import json

import numpy as np

#: Unicode's white space as the vocabularies' pre-tokenizers know it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def explicit_space(pattern: str) -> str:
    """A pattern whose white-space classes are spelled out, so that no library's own table decides."""
    return pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Missing(dict):
    """Numbers keys in the order they are first asked for, and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Merges:
    """The merge table of a tokenizer file, looked up for whole arrays of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in byte_letters()], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = np.int32(len(pairs))
        self._table(np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64))

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing at a tenth of the slots, so that a lookup rarely needs a second look."""
        self.bits = max(4, int(len(keys) * 10).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.none, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.ranks[at] = keys[free[first]], free[first]
            left = np.setdiff1d(left, free[first], assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], self.none)
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[again]]
            hit = found == key[again]
            out[again[hit]] = self.ranks[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbol ids of non-empty byte strings, and how many each has.

        A round finds every sequence's lowest rank among its pairs and merges all its
        occurrences there, in overlaps every second one from the left. A pair made of a new
        symbol has a higher rank than the one that made it, so this equals one merge at a time.
        """
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.inner[data]
        if self.suffix:
            at = np.cumsum(sizes) - 1
            ids[at] = self.last[data[at]]
        seq = np.repeat(np.arange(len(tokens)), sizes)
        done_ids, done_seq = [], []
        while len(ids):
            rank = np.full(len(ids), self.none, np.int32)
            rank[:-1] = self.rank(ids[:-1], ids[1:])
            change = seq[1:] != seq[:-1]
            rank[:-1][change] = self.none
            first = np.flatnonzero(np.r_[True, change])
            counts = np.diff(np.r_[first, len(ids)])
            lowest = np.minimum.reduceat(rank, first)
            over = np.repeat(lowest == self.none, counts)
            if over.any():
                done_ids.append(ids[over])
                done_seq.append(seq[over])
            where = np.flatnonzero((rank == np.repeat(lowest, counts)) & ~over)
            if len(where) > 1:
                order = np.arange(len(where))
                begin = np.maximum.accumulate(np.where(np.r_[True, np.diff(where) != 1], order, 0))
                where = where[(order - begin) % 2 == 0]
            ids[where] = self.made[rank[where]]
            stay = ~over
            stay[where + 1] = False
            ids, seq = ids[stay], seq[stay]
        ids, seq = np.concatenate(done_ids or [ids]), np.concatenate(done_seq or [seq])
        order = np.argsort(seq, kind="stable")
        return ids[order], np.bincount(seq, minlength=len(tokens))
