"""Packing by power-of-two decomposition: no sequence crosses documents and none needs padding.

A document's ids (with the closing id) are cut into whole sequences of 2048 and then into the
powers of two of what is left, largest first. Every piece is a sequence by itself; sequences
are bucketed by length, so a training step takes equal lengths from one bucket.

One map over the texts does it all. sequence_id holds the bucket, the task and a count, from
the high bits to the low, so sequences of a bucket are neighbours in id order and no shuffle
or global count is needed.

Defined cases: a null or empty text is the closing id alone (one piece of length 1); a null
doc_id stays null; repeated rows are packed each by itself; other columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexloom.llm.bpe import Merges, Missing, explicit_space
from lexloom.llm.support import prepare
from lexloom.llm.words import ragged, strings

CLOSING_ID = 1
MAX_TOKENS = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Distinct words a worker keeps encoded; beyond it only the first-met KEPT_WORDS, mostly the common ones, stay.
CACHE_WORDS = 900_000
KEPT_WORDS = 200_000

#: Fixed value: how the vocabulary splits lower-case text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Ids of texts, run by run: no token of this vocabulary crosses ASCII white space.

    Each distinct run of other characters is encoded once; texts are then put together by
    index. Normalisation (NFC, lower case) and the split into words look no further than
    such a run; runs with a special string go to the library.
    """

    def __init__(self, path: str):
        self.path = path
        self.merges = Merges(path)
        self.pattern = regex.compile(explicit_space(PATTERN))
        self._keep(0)

    def _keep(self, n: int) -> None:
        old = list(self.index)[:n] if n else []
        self.index = Missing()
        self.index.update(zip(old, range(n)))
        if n:
            self.used = int(self.at[n - 1] + self.size[n - 1])
            self.ids, self.at, self.size = self.ids[: self.used].copy(), self.at[:n].copy(), self.size[:n].copy()
        else:
            self.used = 0
            self.ids, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _words(self, run: bytes) -> list[bytes]:
        if not run.isascii():
            text = unicodedata.normalize("NFC", run.decode())
            text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        else:
            text = run.decode("ascii").lower()
        return [w.encode() for w in self.pattern.findall(text)]

    def _special(self, run: bytes) -> list[int]:
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(run.decode(), add_special_tokens=False).ids

    def _learn(self, new: list[bytes]) -> None:
        odd = {i: self._special(w) for i, w in enumerate(new) if b"<|" in w and any(s in w for s in self.merges.special)}
        split = [[] if i in odd else self._words(w) for i, w in enumerate(new)]
        tokens = list(dict.fromkeys(t for s in split for t in s))
        number = dict(zip(tokens, range(len(tokens))))
        ids, counts = self.merges.merge(tokens) if tokens else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        begins = np.cumsum(counts) - counts
        use = np.fromiter((number[t] for s in split for t in s), np.int64)
        owner = np.repeat(np.arange(len(new)), [len(s) for s in split])
        size = np.bincount(owner, weights=counts[use], minlength=len(new)).astype(np.int64) if len(use) else np.zeros(len(new), np.int64)
        flat = ids[ragged(begins[use], counts[use])]
        if odd:
            parts = np.split(flat, np.cumsum(size)[:-1])
            for i, v in odd.items():
                parts[i], size[i] = np.array(v, np.int64), len(v)
            flat = np.concatenate(parts)
        used = len(self.ids)
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        self.at = np.concatenate([self.at, used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])

    def encode_all(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n+1 offsets of the texts' ids."""
        if len(self.index) > CACHE_WORDS:
            self._keep(KEPT_WORDS)
        at, n = [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            runs = data[a:b].split()
            at.append(np.fromiter(map(self.index.__getitem__, runs), np.int64, len(runs)))
            n.append(len(runs))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self._learn(new)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        size = self.size[at]
        ends = np.r_[0, np.cumsum(size)][np.cumsum(n)]
        return self.ids[ragged(self.at[at], size)], ends

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all(text, np.array([0, len(text)]))[0]


def decompose(n: int, whole: int = MAX_TOKENS) -> list[int]:
    """n as whole sequences and then falling powers of two."""
    rest = n % whole
    return [whole] * (n // whole) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def resolve(tokenizer: str) -> str:
    """A tokenizer's path: a file as it is, or a name of public_tokenizers; looked up where it is used."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; with_ids adds the piece's ids as array<int>."""
    prepare(docs.sparkSession)
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = encoder(resolve(tokenizer)), TaskContext.get().partitionId()
        counts = [0] * 64
        for batch in batches:
            data, offsets = strings(batch.column(1))
            cols, ids_out = [[] for _ in range(6)], []
            flat, ends = words.encode_all(data.tobytes(), offsets)
            for i in range(batch.num_rows):
                ids = np.append(flat[ends[i] : ends[i + 1]], CLOSING_ID).astype("<u4")
                start = 0
                for length in decompose(len(ids), max_tokens):
                    bucket = length.bit_length() - 1
                    piece = ids[start : start + length]
                    for col, v in zip(cols, (i, start, length, zlib.crc32(piece.tobytes()), len(ids), bucket << 58 | task << 32 | counts[bucket]), strict=True):
                        col.append(v)
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
                    counts[bucket] += 1
                    start += length
            arrays = [pc.take(batch.column(0), pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(np.zeros(len(cols[0]), np.int64))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
