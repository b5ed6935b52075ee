"""Token counts of a byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Pre-tokens that a worker has not met are put side by side in one flat array of symbol ids.
In each round every pre-token looks up the ranks of its neighbouring pairs, takes its lowest,
and merges all its occurrences at once, left to right; what survives when no pair has a rank
is counted. Counts of units (a run without ASCII space and the space before it) are kept, so
a text is a sum over its units.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings count as one
token each, as the library takes them by default; repeated rows are counted each; a null
doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexloom.llm.bpe import Merges, Missing, explicit_space
from lexloom.llm.packing import resolve
from lexloom.llm.support import prepare
from lexloom.llm.words import strings

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: Distinct units a worker keeps counted; beyond it only the first-met KEPT_UNITS, mostly the common ones, stay.
CACHE_UNITS = 900_000
KEPT_UNITS = 200_000

#: Fixed value: how the vocabulary splits text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space at an end or beside other white space, or white space outside ASCII: such texts are split as a whole.
_UNEVEN = re.compile(rb"[ \t-\r] | [ \t-\r]|\A | \Z|[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class MergeCounter:
    """Counts tokens as the tokenizers library would for the same file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.split_special = re.compile(b"|".join(map(re.escape, self.merges.special))) if self.merges.special else None
        self.pattern = regex.compile(explicit_space(PATTERN))
        self.index, self.counts = Missing(), np.zeros(0, np.int64)

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        split = [[t.encode() for t in self.pattern.findall(u.decode())] for u in new]
        tokens = list(dict.fromkeys(t for s in split for t in s))
        number = dict(zip(tokens, range(len(tokens))))
        counts = self.merges.merge(tokens)[1]
        use = np.fromiter((number[t] for s in split for t in s), np.int64)
        owner = np.repeat(np.arange(len(new)), [len(s) for s in split])
        self.counts = np.r_[self.counts, np.bincount(owner, weights=counts[use], minlength=len(new)).astype(np.int64)]

    def _units(self, text: bytes) -> list[int]:
        """Numbers of the units of a text: a run without a space, with the space before it."""
        if _UNEVEN.search(text):
            return [self.index[t.encode()] for t in self.pattern.findall(text.decode())]
        first, *rest = text.split(b" ")
        return [self.index[first], *map(self.index.__getitem__, [b" " + u for u in rest])]

    def count_all(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        if len(self.index) > CACHE_UNITS:
            old = list(self.index)[:KEPT_UNITS]
            self.index, self.counts = Missing(), self.counts[:KEPT_UNITS].copy()
            self.index.update(zip(old, range(KEPT_UNITS)))
        units, n, extra = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = data[a:b]
            parts = self.split_special.split(text) if b"<|" in text and self.split_special else [text]
            own = [u for p in parts if p for u in self._units(p)] if len(parts) > 1 else self._units(text) if text else []
            units.append(np.array(own, np.int64))
            n.append(len(own))
            extra.append(len(parts) - 1)
        if self.index.new:
            self._learn()
        sums = np.r_[0, np.cumsum(self.counts[np.concatenate(units)])] if units else np.zeros(1, np.int64)
        ends = np.cumsum(n, dtype=np.int64)
        return sums[ends] - sums[ends - n] + np.array(extra, np.int64)

    def count(self, text: bytes) -> int:
        return int(self.count_all(text, np.array([0, len(text)]))[0])


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(resolve(tokenizer))
        for batch in batches:
            data, offsets = strings(batch.column(1))
            n = bpe.count_all(data.tobytes(), offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
