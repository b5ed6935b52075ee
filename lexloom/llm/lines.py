"""Lines of Arrow text columns and what can be counted in them, in numpy."""

from __future__ import annotations

import numpy as np

from lexloom.llm.words import mix, names, spans

#: Kinds of bytes. 0 is any other byte.
LOWER, UPPER, DIGIT, SPACE, STOP, BANG, SYMBOL, BAR, PUNCT, WIDE, KINDS = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11
_KIND = np.zeros(256, np.int64)
_KIND[ord("a") : ord("z") + 1] = LOWER
_KIND[ord("A") : ord("Z") + 1] = UPPER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[0xC2:0xF5] = WIDE
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = STOP if chr(_c) in ".,;:?" else BANG if chr(_c) == "!" else BAR if chr(_c) == "|" else SYMBOL if chr(_c) in "#*$%&<>" else PUNCT


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-split lines (each row has one at least), and n+1 offsets of the rows' lines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.r_[offsets[:-1], breaks + 1])
    row = np.r_[np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1]
    row = row[np.argsort(np.r_[offsets[:-1], breaks + 1], kind="stable")]
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    first = np.searchsorted(row, np.arange(len(offsets)))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of each kind in each of neighbouring spans that don't overlap."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    part = data[np.cumsum(inside)[:-1] > 0]
    return np.bincount(owner * KINDS + _KIND[part], minlength=len(starts) * KINDS).reshape(-1, KINDS)


def repeated(key: np.ndarray) -> np.ndarray:
    """True where a value has stood before in the array."""
    _, first = np.unique(key, return_index=True)
    out = np.ones(len(key), bool)
    out[first] = False
    return out


FEATURES = 17


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with their neighbours' beside them, n+1 offsets of the rows' lines, and lengths in bytes."""
    starts, ends, rows = line_spans(data, offsets)
    count = kinds(data, starts, ends).astype(np.float64)
    w_starts, w_ends, _ = spans(data, offsets)
    words = names(data, w_starts, w_ends)
    line = np.searchsorted(starts, w_starts, "right") - 1
    n = np.bincount(line, minlength=len(starts)).astype(np.float64)
    tagged = mix(words ^ mix(line.astype(np.uint64)))
    again = np.bincount(line[repeated(tagged)], minlength=len(starts))
    beside = np.zeros(len(starts))
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
        beside = np.bincount(line[1:][same], minlength=len(starts)).astype(np.float64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    twin = repeated(mix(names(data, starts, ends) ^ mix(doc.astype(np.uint64)))) & (n > 0)
    size = np.maximum(ends - starts, 1)
    last = np.where(ends > starts, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    own = np.c_[
        count[:, 1:] / size[:, None],
        np.log1p(n),
        np.log1p((count[:, LOWER] + count[:, UPPER] + 2 * count[:, WIDE]) / np.maximum(n, 1)),
        beside / np.maximum(n, 1),
        again / np.maximum(n, 1),
        twin,
        np.log1p(ends - starts),
        np.isin(last, np.frombuffer(b".?!", np.uint8)),
    ]
    has_before, has_after = np.ones(len(own)), np.ones(len(own))
    has_before[rows[:-1]], has_after[rows[1:] - 1] = 0, 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.c_[own, before * has_before[:, None], after * has_after[:, None], has_before, has_after], rows, ends - starts
