"""Substring dedup by recompression: each word of a 13-word window that starts in an earlier document goes.

Words get 64-bit names from their bytes, and every round names symbols of symbols: first each
maximal run of one symbol becomes a symbol named by what is repeated and how often, then every
symbol falls left or right by a bit of its name and a left one with a right one behind it
becomes one symbol named by the two. A name is a hash of what it stands for, so all documents,
tasks and runs name alike: a round needs no exchange of a dictionary, and Spark runs the rounds
of a batch of documents inside one narrow stage.

Symbols inside a repeat are the same wherever it stands; only those at its borders may have
grown into their surroundings. In each round a window gives up the runs at both ends, then a
right symbol at its left end and a left one at its right end; what it keeps follows from its own
words (`interiors`). So a window has a name of its own: the names of its consistent symbols of
the highest round that leaves any, with the words at the borders that were given up, each with
its place (`signatures`). Equal windows have equal names and differing ones don't (64 bits, and
32 of an anchor beside them).

A window's anchor is the one among its consistent symbols of the first round, in the front
half, whose name is smallest. The anchor with the PHRASE words it begins reveals repeats: it
deals windows to buckets, so neighbouring windows go together and a passage's windows meet in a
few buckets, however often it is copied. A bucket verifies by the windows' names and answers
with the covered stretches (document, first window, number), one row for each: as many as there
are repeats, whatever the number of buckets. What a batch of documents has twice is settled
there: the smallest document's windows go to the buckets, the others' are covered already.

Defined cases: null text has no words; a null doc_id comes after all others; rows with one
doc_id don't cover each other, and differing texts of one doc_id are told apart by a hash of
the text; documents of under 13 words lose nothing; repeated rows share what is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.support import Stage, free_name, prepare, row_key, row_tag
from lexloom.llm.words import grams, mix, names, places, ragged, spans, strings

WINDOW = 13
ROUNDS = 2
PHRASE = 7

#: Bytes of text for one bucket of windows, on average.
BUCKET_BYTES = 8 << 20

#: Bytes of text whose windows are named at once; a longer document is taken by itself.
SLICE_BYTES = 3 << 20

_RUN = np.uint64(0xD6E8FEB86659FD93)
_PAIR = np.uint64(0xA24BAED4963EE407)
_OFFSET = np.uint64(7)


class Symbols:
    """One round's symbols of all documents of a batch: names, first words, and where in words the last one ends."""

    def __init__(self, name: np.ndarray, at: np.ndarray, row: np.ndarray, n_words: int):
        self.name, self.at, self.row, self.n_words = name, at, row, n_words

    def ends(self) -> np.ndarray:
        """First word of each symbol, and the number of words behind the last one."""
        return np.r_[self.at, self.n_words]


def runs_of(s: Symbols) -> tuple[Symbols, np.ndarray]:
    """Each maximal run of one symbol within a document as one symbol, and the number of the run that each symbol is in."""
    first = np.ones(len(s.name), bool)
    first[1:] = (s.name[1:] != s.name[:-1]) | (s.row[1:] != s.row[:-1])
    head = np.flatnonzero(first)
    size = np.diff(np.r_[head, len(first)])
    name = s.name[head]
    many = size > 1
    name[many] = mix(name[many] * _RUN ^ mix(size[many].astype(np.uint64)))
    return Symbols(name, s.at[head], s.row[head], s.n_words), np.cumsum(first) - 1


def sides(s: Symbols, k: int) -> np.ndarray:
    """Whether each symbol is a right one in round k."""
    return (mix(s.name + np.uint64(int(_PAIR) * (k + 1) % 2**64)) & np.uint64(1)).astype(bool)


def pairs_of(s: Symbols, right: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Left symbols with right ones behind them as one symbol, and the number of the new symbol that each one is in."""
    second = np.zeros(len(s.name), bool)
    second[1:] = ~right[:-1] & right[1:] & (s.row[:-1] == s.row[1:])
    head = np.flatnonzero(~second)
    name = s.name[head]
    pair = np.zeros(len(s.name) + 1, bool)
    pair[:-1] = second
    joined = pair[head + 1]
    name[joined] = mix(mix(name[joined] * _PAIR) ^ s.name[head[joined] + 1])
    return Symbols(name, s.at[head], s.row[head], s.n_words), np.cumsum(~second) - 1


def interiors(words: np.ndarray, row: np.ndarray, starts: np.ndarray) -> list[tuple[Symbols, np.ndarray, np.ndarray]]:
    """For each round from none on: its symbols and, for the window at each start, the first consistent one and the one behind the last.

    A window that a round leaves without consistent symbols has an empty range there and in all later rounds.
    """
    s = Symbols(words, np.arange(len(words)), row, len(words))
    low, high = starts, starts + WINDOW
    out = [(s, low, high)]
    for k in range(ROUNDS):
        if not len(s.name):
            out.append((s, low, high))
            continue
        open_ = low < high
        s, run = runs_of(s)
        top = len(run) - 1
        low, high = run[np.minimum(low, top)] + 1, run[np.minimum(np.maximum(high - 1, 0), top)]
        right = sides(s, k)
        top = len(right) - 1
        low = low + (open_ & (low < high) & right[np.minimum(low, top)])
        high = high - (open_ & (low < high) & ~right[np.clip(high - 1, 0, top)])
        open_ &= low < high
        s, pair = pairs_of(s, right)
        low, high = np.where(open_, pair[np.minimum(low, top)], 0), np.where(open_, pair[np.clip(high - 1, 0, top)] + 1, 0)
        out.append((s, low, high))
    return out


def signatures(levels: list[tuple[Symbols, np.ndarray, np.ndarray]], starts: np.ndarray) -> np.ndarray:
    """Each window's name: its consistent symbols of the highest round that leaves any, the words around them, all with their places."""
    up, down = places(levels[0][0].n_words + 1)
    sums = []
    for k, (s, _, _) in enumerate(levels):
        total = np.zeros(len(s.name) + 1, np.uint64)
        np.cumsum(mix(s.name + np.uint64(k)) * up[s.at], out=total[1:])
        sums.append(total)
    end = starts + WINDOW
    out = sums[0][end] - sums[0][starts]
    for k, (s, low, high) in enumerate(levels[1:], 1):
        has = np.flatnonzero(low < high)
        if len(has):
            edge = s.ends()
            a, b = low[has], high[has]
            left, behind = edge[a], edge[b]
            out[has] = sums[0][left] - sums[0][starts[has]] + sums[k][b] - sums[k][a] + sums[0][end[has]] - sums[0][behind]
    return mix(out * down[starts])


def anchors(levels: list[tuple[Symbols, np.ndarray, np.ndarray]], starts: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor: its first word and a name of the symbol and the phrase that it begins.

    A window without a consistent symbol in its front half takes one of the words there.
    """
    words, (first, low, high) = levels[0][0], levels[1]
    begins = np.zeros(words.n_words + 1, bool)
    begins[first.at] = True
    rank = mix(words.name)
    rank[first.at] = mix(first.name)
    edge = first.ends()
    left, behind = np.where(low < high, edge[np.minimum(low, len(edge) - 1)], starts), np.where(low < high, edge[np.minimum(high, len(edge) - 1)], starts)
    none = np.uint64(2**64 - 1)
    best, plain = np.full(len(starts), none), np.full(len(starts), none)
    word_rank = mix(words.name ^ _RUN)
    for k in range(WINDOW - PHRASE + 1):
        at = starts + k
        here = np.where(begins[at] & (at >= left) & (at < behind), rank[at] & ~_OFFSET | np.uint64(k), none)
        best = np.minimum(best, here)
        plain = np.minimum(plain, word_rank[at] & ~_OFFSET | np.uint64(k))
    best = np.where(best == none, plain, best)
    at = starts + (best & _OFFSET).astype(np.int64)
    return at, mix(phrase[at] ^ (best & ~_OFFSET))


def window_starts(offsets: np.ndarray) -> np.ndarray:
    """All words at which a window of their document starts."""
    return ragged(offsets[:-1], np.maximum(np.diff(offsets) - WINDOW + 1, 0))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = strings(column)
    starts, ends, word_offsets = spans(data, offsets)
    return data, starts, ends, word_offsets


def _heads(*columns: np.ndarray) -> np.ndarray:
    """True at each row of sorted columns that differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


#: A bucket's rows: documents (key, tag and stretches each), stretches (first window, number of windows, anchor) and the windows' names, if still to be settled.
_PACK = "bucket int, keys binary, tags binary, stretches binary, first binary, size binary, anchor binary, names binary"
_PACK_NAMES = [c.split()[0] for c in _PACK.split(", ")]


def _pack(bucket: np.ndarray, row: np.ndarray, key: np.ndarray, tag: np.ndarray, first: np.ndarray, size: np.ndarray, anchor: np.ndarray, name: np.ndarray, name_at: np.ndarray) -> list[tuple]:
    """A row for each bucket of stretches; a stretch's names are the size ones from name_at on, none where name is empty."""
    order = np.lexsort((first, row, bucket))
    bucket, row, first, size, anchor = bucket[order], row[order], first[order], size[order], anchor[order]
    if len(name):
        name = name[ragged(name_at[order], size)]
    upto = np.r_[0, np.cumsum(size)]
    edges = np.r_[np.flatnonzero(_heads(bucket)), len(bucket)]
    rows = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        head = np.flatnonzero(_heads(row[a:b]))
        docs = row[a:b][head]
        rows.append((
            int(bucket[a]), key[docs].astype("<i8").tobytes(), tag[docs].astype("<i8").tobytes(), np.diff(np.r_[head, b - a]).astype("<u4").tobytes(),
            first[a:b].astype("<u4").tobytes(), size[a:b].astype("<u4").tobytes(), anchor[a:b].astype("<u4").tobytes(), name[upto[a] : upto[b]].astype("<u8").tobytes() if len(name) else b"",
        ))
    return rows


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text."""
    _, bounds = strings(batch.column(text))
    part = bounds[:-1] // SLICE_BYTES
    edges = np.r_[np.flatnonzero(_heads(part)), len(part)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def _send(buckets: int):
    """Windows of each slice of a batch to their buckets; what the slice itself settles goes along by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            key, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, w_starts, w_ends, offsets = _words(batch.column(2))
            words = names(data, w_starts, w_ends)
            row = np.repeat(np.arange(len(key)), np.diff(offsets))
            at = window_starts(offsets)
            if not len(at):
                continue
            levels = interiors(words, row, at)
            name = signatures(levels, at)
            phrase, _ = grams(words, offsets, PHRASE)
            _, anchor = anchors(levels, at, phrase)
            owner = row[at]
            order = np.lexsort((key[owner], name))  # a window's smallest document of the batch sends it
            head = _heads(name[order])
            least = key[owner[order]][head][np.cumsum(head) - 1]
            sent = np.zeros(len(at), bool)
            sent[order] = key[owner[order]] == least
            i = np.flatnonzero(sent)
            heads, size = _stretches(at[i], owner[i], anchor[i])
            code = anchor[i[heads]]
            rows = _pack(
                ((code >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), owner[i[heads]], key, tag, (at - offsets[owner])[i[heads]], size, code & np.uint64(0xFFFFFFFF), name[i], heads
            )
            i = np.flatnonzero(~sent)
            if len(i):
                heads, size = _stretches(at[i], owner[i], None)
                docs = owner[i[heads]]
                rows += _pack((tag[docs] & 0x7FFFFFFF) % buckets, docs, key, tag, (at - offsets[owner])[i[heads]], size, np.zeros(len(heads), np.uint64), name[:0], heads)
            types = [pa.int32()] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _PACK_NAMES)

    return run


def _stretches(at: np.ndarray, owner: np.ndarray, anchor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of neighbouring windows (of one anchor) begin, and how many windows each has."""
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])
    if anchor is not None:
        head[1:] |= anchor[1:] != anchor[:-1]
    heads = np.flatnonzero(head)
    return heads, np.diff(np.r_[heads, len(at)])


_COVER = "key long, tag long, first long, size long"


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Covered stretches of a bucket: windows whose name a smaller document has too, and those settled before."""

    def column(name: str, kind: str, rows: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(rows[name]), kind)

    def stretches(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        of = column("stretches", "<u4", rows)
        return np.repeat(column("keys", "<i8", rows), of), np.repeat(column("tags", "<i8", rows), of), column("first", "<u4", rows).astype(np.int64), column("size", "<u4", rows).astype(np.int64)

    settled = pdf["names"].map(len) == 0
    done = stretches(pdf[settled])
    rows = pdf[~settled]
    key, tag, first, size = stretches(rows)
    window = column("names", "<u8", rows)
    stretch = np.repeat(np.arange(len(size)), size)
    anchor = column("anchor", "<u4", rows)[stretch]
    order = np.lexsort((key[stretch], window, anchor))
    head = _heads(anchor[order], window[order])
    sorted_key = key[stretch[order]]
    covered = np.zeros(len(window), bool)
    covered[order] = sorted_key > sorted_key[head][np.cumsum(head) - 1] if len(order) else False
    place = first[stretch] + np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
    i = np.flatnonzero(covered)
    begin = np.flatnonzero(np.r_[True, (place[i][1:] != place[i][:-1] + 1) | (stretch[i][1:] != stretch[i][:-1])]) if len(i) else np.zeros(0, np.int64)
    found = stretch[i[begin]]
    return pd.DataFrame({
        "key": np.r_[done[0], key[found]], "tag": np.r_[done[1], tag[found]], "first": np.r_[done[2], place[i[begin]]], "size": np.r_[done[3], np.diff(np.r_[begin, len(i)])],
    })


def covered_words(offsets: np.ndarray, covers: pa.Array) -> np.ndarray:
    """Whether each word lies in a covered window; covers holds each row's list of stretches (first, size) or null."""
    step = np.zeros(int(offsets[-1]) + 1, np.int64)
    covers = covers.combine_chunks() if isinstance(covers, pa.ChunkedArray) else covers
    sizes = np.array(pc.fill_null(pc.list_value_length(covers), 0), np.int64)
    flat = covers.flatten()
    if len(flat):
        first, size = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        begin = np.repeat(offsets[:-1], sizes) + first
        np.add.at(step, begin, 1)
        np.add.at(step, begin + size + WINDOW - 1, -1)
    return np.cumsum(step)[:-1] > 0


def _remove(text: int, covers: int, keep: list[int], with_text: bool, n_chars: int | None = None):
    """Cut covered words; columns by place in the batch. with_text gives new texts (and n_chars), else digests of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends, offsets = _words(batch.column(text))
            gone = covered_words(offsets, batch.column(covers))
            n_removed = np.diff(np.r_[0, np.cumsum(gone)][offsets])
            raw = data.tobytes()
            _, bounds = strings(batch.column(text))
            touched = np.flatnonzero(n_removed)
            if with_text:
                texts, chars = batch.column(text).to_pylist(), batch.column(n_chars).to_pylist() if n_chars is not None else []
                for i in touched.tolist():
                    a, b, lo, hi = offsets[i], offsets[i + 1], bounds[i], bounds[i + 1]
                    stay = np.ones(hi - lo, bool)
                    cut = np.flatnonzero(gone[a:b]) + a
                    until = np.r_[starts[a + 1 : b], hi]  # a word goes with the space behind it
                    stay[ragged(starts[cut] - lo, until[cut - a] - starts[cut])] = False
                    texts[i] = data[lo:hi][stay].tobytes().decode()
                    if n_chars is not None:
                        chars[i] = len(texts[i])
                new = {text: texts} | ({n_chars: chars} if n_chars is not None else {})
                yield pa.RecordBatch.from_arrays([pa.array(new[i], batch.schema.field(i).type) if i in new else batch.column(i) for i in keep], [batch.schema.names[i] for i in keep])
                continue
            kept = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() if not n else None for a, b, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), n_removed.tolist(), strict=True)]
            for i in touched.tolist():
                stay = np.flatnonzero(~gone[offsets[i] : offsets[i + 1]]) + offsets[i]
                kept[i] = hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])).hexdigest()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(kept, pa.string())], [*(batch.schema.names[i] for i in keep), "n_words", "n_removed", "kept_sha256"])

    return run


def covers_of(docs: DataFrame, stage: Stage) -> DataFrame:
    """A row for each text that loses words: key, tag and covers, the stretches of its windows that are covered."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, n_bytes // BUCKET_BYTES)
    texts = docs.select(row_key(docs).alias("key"), row_tag(docs).alias("tag"), docs["text"].cast("string").alias("text"))
    found = texts.mapInArrow(_send(buckets), _PACK).groupBy("bucket").applyInPandas(_settle, _COVER)
    return stage.write(found, "covered").groupBy("key", "tag").agg(F.collect_list(F.struct("first", "size")).alias("covers"))


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) of every row."""
    prepare(docs.sparkSession)
    stage = Stage(docs.sparkSession, "substring-dedup")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), row_key(docs).alias("key"), row_tag(docs).alias("tag"))
    joined = texts.join(covers_of(docs, stage), ["key", "tag"], "left").select("doc_id", "text", "covers")
    return joined.mapInArrow(_remove(1, 2, [0], False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with covered words, and the white space behind them, cut from the text; n_chars follows where it is a column."""
    prepare(docs.sparkSession)
    stage = Stage(docs.sparkSession, "substring-dedup")
    key, tag, covers = (free_name(docs, x) for x in ("_key", "_tag", "_covers"))
    found = covers_of(docs, stage).select(F.col("key").alias(key), F.col("tag").alias(tag), F.col("covers").alias(covers))
    joined = docs.withColumns({key: row_key(docs), tag: row_tag(docs)}).join(found, [key, tag], "left").select(*docs.columns, covers)
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    cut = _remove(docs.columns.index("text"), len(docs.columns), list(range(len(docs.columns))), True, n_chars)
    return joined.mapInArrow(cut, docs.schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) t WHERE len(w) >= 13),
f AS (SELECT g, min(doc_id) AS first_id FROM s GROUP BY g HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT s.doc_id, list(s.i) AS starts FROM s JOIN f USING (g) WHERE s.doc_id > f.first_id GROUP BY s.doc_id),
c AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list_transform(starts, lambda x: range(x, x + 13))))) AS gone FROM r),
k AS (
  SELECT d.doc_id, d.w, coalesce(c.gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
o AS (
  SELECT doc_id, w, gone,
         CASE WHEN len(gone) = 0 THEN w ELSE list_where(w, list_transform(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x))) END AS kept
  FROM k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM o
"""
