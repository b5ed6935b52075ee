"""Words of Arrow string columns as numpy arrays of 64-bit names, without a Python object per word.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]; UTF-8 makes that the same as the
runs of characters. A word's name depends on its bytes alone, so it is the same in every
document, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: Bytes that are hashed at once; a longer word makes a longer piece.
CHUNK = 1 << 20

#: Bytes of text whose words or lines are held as arrays at once; these take tens of times the text.
SLICE = 1 << 20

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if n <= 2 * CHUNK:
            _powers[kind] = have
    return have[:n]


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in runs, each begun within SLICE bytes of the text in column at; a row is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // SLICE
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n+1 offsets of the rows' words."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = offsets[:-1]
        before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = offsets[1:]
        after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each span of bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        piece = data[lo : ends[j - 1]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * _power("up", _BASE, len(piece)), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * _power("down", _INVERSE, len(piece) + 1)[s]
        i = j
    return mix(out + np.uint64(1))


def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors of n places and their inverses: sums of names times factors don't mix up places."""
    return _power("up", _BASE, n), _power("down", _INVERSE, n)


def grams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of n words within a row, and for each position whether one starts there.

    names[i] is the name of words[i:i+n]; it holds no meaning where valid[i] is false.
    """
    total = len(words)
    out = np.zeros(total, np.uint64)
    if total >= n:
        width = total - n + 1
        acc = np.zeros(width, np.uint64)
        for k in range(n):
            acc = (acc ^ words[k : k + width]) * np.uint64(0xD6E8FEB86659FD93)
            acc ^= acc >> np.uint64(32)
        out[:width] = mix(acc)
    valid = np.ones(total, bool)
    lengths = np.diff(offsets)
    back = np.repeat(offsets[1:], lengths) - np.arange(total)
    valid[back < n] = False
    return out, valid


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def code_points(data: np.ndarray) -> np.ndarray:
    """True for each byte that begins a character."""
    return (data & 0xC0) != 0x80
