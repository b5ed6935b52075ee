"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The model file's normal pieces and their log scores make the lattice; a character that no
piece covers costs UNKNOWN below the lowest score and comes out as its UTF-8 bytes' pieces.
No piece holds a white-space marker after another character (checked when a model is loaded), so the best path of a text is
the best paths of its units (markers, then other characters) side by side, and a worker
solves each distinct unit once, all new units of a batch together in numpy.

The model's normaliser is read: the identity with a marker put before and spaces escaped is
what is done here; a model that asks for another one is refused, not encoded wrongly. The installed
file ranks its pieces by merges; as a unigram model its ids equal the library's for the same
file with that type (its 15 unranked white-space pieces set aside).

Ties: at an end position the path whose last piece is longest wins. A space becomes the
marker and one marker is put before a text; decoding turns markers into spaces and drops
that one, so every text without a literal marker comes back byte for byte.

Defined cases: null and empty texts have no pieces; repeated rows are encoded each; a null
doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexloom.llm.bpe import Missing
from lexloom.llm.packing import resolve
from lexloom.llm.support import prepare
from lexloom.llm.words import code_points, ragged, strings

MARK = "▁".encode()
UNKNOWN = 10.0
SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"
CACHE_UNITS = 900_000
KEPT_UNITS = 200_000

#: Scores at or below this mark pieces that the trainer left out of its ranking.
UNRANKED = -1e8

_UNIT = re.compile(rb"(?:\xe2\x96\x81)+(?:(?!\xe2\x96\x81)[\s\S])*|(?:(?!\xe2\x96\x81)[\s\S])+")


class DoubleArray:
    """A trie of byte strings in two arrays: a child of s by byte b is base[s]+b+1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        self.value = np.full(1024, -1, np.int32)
        self.base = np.zeros(1024, np.int32)
        self.check = np.full(1024, -1, np.int32)
        self.check[0] = 0
        order = sorted(range(len(keys)), key=keys.__getitem__)
        todo, lowest = [(0, 0, len(order), 0)], 1
        check = self.check.tolist()
        base, value = [0] * len(check), [-1] * len(check)
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[order[lo]]) == depth:
                value[node] = order[lo]
                lo += 1
            if lo >= hi:
                continue
            cuts, at = [], lo
            for i in range(lo, hi):
                if i == lo or keys[order[i]][depth] != keys[order[i - 1]][depth]:
                    cuts.append((keys[order[i]][depth], i))
            at = max(lowest, 1)
            first = cuts[0][0] + 1
            while True:
                while at < len(check) and check[at] >= 0:
                    at += 1
                b = at - first
                if b >= 0:
                    top = b + cuts[-1][0] + 2
                    if top > len(check):
                        grow = max(top - len(check), len(check))
                        check += [-1] * grow
                        base += [0] * grow
                        value += [-1] * grow
                    if all(check[b + c + 1] < 0 for c, _ in cuts):
                        break
                at += 1
            if len(cuts) == 1:
                lowest = at
            base[node] = b
            for k, (c, i) in enumerate(cuts):
                check[b + c + 1] = node
                todo.append((b + c + 1, i, cuts[k + 1][1] if k + 1 < len(cuts) else hi, depth + 1))
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))
        pad = np.full(258, -1, np.int32)
        self.base, self.check, self.value = np.r_[self.base, pad * 0], np.r_[self.check, pad], np.r_[self.value, pad]

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and which of the steps exist."""
        to = self.base[state] + byte + 1
        return to, self.check[to] == state


def _check_normaliser(proto: bytes) -> None:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(proto)
    how, suffix = model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix
    if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.add_dummy_prefix or not how.escape_whitespaces or suffix:
        raise ValueError(f"normaliser {how.name!r} is not the identity with a marker before the text")


class Unigram:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _check_normaliser(model.serialized_model_proto())
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i).encode() for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids, self.score = np.array(plain, np.int64), scores[plain]
        odd = [i for i in plain if MARK in self.pieces[i].lstrip(MARK)]
        if odd:
            raise ValueError(f"piece {odd[0]} holds a white-space marker after another character")
        self.trie = DoubleArray([self.pieces[i] for i in plain])
        self.unknown = self.score[self.score > UNRANKED].min() - UNKNOWN
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                b = int(self.pieces[i].decode()[1:-1], 16)
                self.byte_ids[b], self.pieces[i] = i, bytes([b])
            elif model.is_control(i):
                self.pieces[i] = b""
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        self._keep(0)

    def _keep(self, n: int) -> None:
        old = list(self.index)[:n] if n else []
        self.index = Missing()
        self.index.update(zip(old, range(n)))
        if n:
            self.at, self.size, self.good = self.at[:n].copy(), self.size[:n].copy(), self.good[:n].copy()
            self.flat = self.flat[: self.at[-1] + self.size[-1]].copy()
        else:
            self.at, self.size, self.flat, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def viterbi(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best path of each non-empty unit, and how many each has."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        data = np.frombuffer(b"".join(units), np.uint8)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        unit = np.repeat(np.arange(len(units)), sizes)
        start = np.flatnonzero(code_points(data))
        width = np.diff(np.r_[start, len(data)])
        found, state, at, own = [], np.zeros(len(start), np.int32), start, np.arange(len(start))
        single = np.zeros(len(start), bool)
        while len(at):
            state, ok = self.trie.step(state, data[at])
            state, at, own = state[ok], at[ok] + 1, own[ok]
            value = self.trie.value[state]
            hit = value >= 0
            found.append((own[hit], at[hit], value[hit]))
            single[own[hit][at[hit] - start[own[hit]] == width[own[hit]]]] = True
            more = at < ends[unit[start[own]]]
            state, at, own = state[more], at[more], own[more]
        alone = np.flatnonzero(~single)
        found.append((alone, start[alone] + width[alone], np.full(len(alone), -1, np.int32)))
        own, to, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        gain = np.where(piece >= 0, self.score[piece], self.unknown)
        # positions are numbered with one extra place per unit for its end
        place = start[own] + unit[start[own]]
        to_place = to + unit[start[own]]
        step = start[own] - begins[unit[start[own]]]
        order = np.argsort(step, kind="stable")
        place, to_place, piece, gain, step = place[order], to_place[order], piece[order], gain[order], step[order]
        best = np.full(len(data) + len(units), -np.inf)
        via = np.full(len(best), -1, np.int64)
        best[begins + np.arange(len(units))] = 0.0
        cuts = np.r_[0, np.flatnonzero(np.diff(step)) + 1, len(step)] if len(step) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            score = best[place[i:j]] + gain[i:j]
            better = np.flatnonzero(score > best[to_place[i:j]])
            best[to_place[i:j][better]] = score[better]
            via[to_place[i:j][better]] = i + better
        here, who = ends + np.arange(len(units)), np.arange(len(units))
        floor = begins + np.arange(len(units))
        path_unit, path_edge = [], []
        while len(who):
            edge = via[here]
            path_unit.append(who)
            path_edge.append(edge)
            here = place[edge]
            more = here > floor[who]
            here, who = here[more], who[more]
        owner = np.concatenate(path_unit)[::-1]
        edge = np.concatenate(path_edge)[::-1]
        order = np.argsort(owner, kind="stable")
        owner, edge = owner[order], edge[order]
        made = np.where(piece[edge] >= 0, 1, to_place[edge] - place[edge])
        out = np.zeros(int(made.sum()), np.int64)
        first = np.cumsum(made) - made
        known = piece[edge] >= 0
        out[first[known]] = self.ids[piece[edge[known]]]
        lost = edge[~known]
        if len(lost):
            span = to_place[lost] - place[lost]
            from_data = place[lost] - owner[~known]
            out[ragged(first[~known], span)] = self.byte_ids[data[ragged(from_data, span)]]
        return out, np.bincount(owner, weights=made, minlength=len(units)).astype(np.int64)

    def _learn(self, new: list[bytes]) -> None:
        ids, size = self.viterbi(new)
        ends = np.cumsum(size)
        flat = ids.tolist()
        good = [b"".join(map(self.pieces.__getitem__, flat[e - n : e])) == u for u, e, n in zip(new, ends.tolist(), size.tolist(), strict=True)]
        used = len(self.flat)
        self.flat = np.r_[self.flat, ids.astype(np.int32)]
        self.at, self.size, self.good = np.r_[self.at, used + ends - size], np.r_[self.size, size], np.r_[self.good, np.array(good, bool)]

    def _units(self, text: bytes) -> list[bytes]:
        marked = MARK + text.replace(b" ", MARK)
        if b"  " in text or MARK in text or text[:1] == b" " or text[-1:] == b" ":
            return _UNIT.findall(marked)
        return [MARK + u for u in text.split(b" ")]

    def encode_all(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the n+1 offsets of the texts' ids, and whether each text decodes to itself."""
        if len(self.index) > CACHE_UNITS:
            self._keep(KEPT_UNITS)
        at, n, literal = [], [0], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = data[a:b]
            units = self._units(text) if text else []
            at.append(np.fromiter(map(self.index.__getitem__, units), np.int64, len(units)))
            n.append(len(units))
            literal.append(MARK in text)
        if self.index.new:
            new, self.index.new = self.index.new, []
            self._learn(new)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        size, bounds = self.size[at], np.cumsum(n)
        bad = np.r_[0, np.cumsum(~self.good[at])][bounds]
        return self.flat[ragged(self.at[at], size)], np.r_[0, np.cumsum(size)][bounds], (np.diff(bad) == 0) & ~np.array(literal, bool)

    def encode(self, text: str) -> list[int]:
        raw = text.encode()
        return self.encode_all(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes of the pieces, markers as spaces, without the one put before; broken UTF-8 becomes U+FFFD."""
        text = b"".join(self.pieces[i] for i in ids).replace(MARK, b" ")
        return text.removeprefix(b" ").decode("utf-8", "replace")


_models: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(path)
    return _models[path]


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", with_ids: bool = False) -> DataFrame:
    """Counts, a checksum of the ids (unsigned 32-bit, little-endian) and the round trip of every text; with_ids adds the ids."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = unigram(resolve(model))
        for batch in batches:
            data, offsets = strings(batch.column(1))
            ids, ends, good = coder.encode_all(data.tobytes(), offsets)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            lost = np.r_[0, np.cumsum(coder.is_byte[ids])][ends]
            arrays = [batch.column(0), pa.array(np.diff(ends)), pa.array(np.diff(lost)), pa.array(crc, pa.int64()), pa.array(good)]
            names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = unigram(resolve(model))
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
