"""Marked-up sources: a parser of one text, and the tables it gives for many.

parse() reads headings, metadata and tagged blocks; tokens() reads a block's inline mark-up in
an edited and an original version. Bad mark-up gives errors, never exceptions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.words import TOKEN

_HEADING = re.compile(r"^(#{1,6})\s+(\S.*?)\s*$")
_TAG = re.compile(r'^\{#([^,}\s]+)((?:\s*,\s*\w+\s*=\s*(?:"[^"]*"|\[[^\]]*\]))*)\s*\}\s*$')
_PAIR = re.compile(r'(\w+)\s*=\s*("[^"]*"|\[[^\]]*\])')
_ASSIGN = re.compile(r'^("(?:[^"]*)"|[^=\s]+)\s*=\s*(.+?)\s*$')
_FRAME = {"p": "person", "l": "place", "o": "org"}
_PLAIN = re.compile(r"[^\\<\[\]$_*{}/]+")
_TAGGED = re.compile(r"<n?\w+>")
_PAGE = re.compile(r"//[^/\n]*//|///")
_WORD = re.compile(r"\[w:((?:[^\]=\\]|\\.)*)=((?:[^\]\\]|\\.)*)\]")
_EDIT = re.compile(r"\[([-+])(.*?)\1\]", re.S)
_OPEN = re.compile(r"\[([plo]):")
_SPOKEN = re.compile(r"\$(?:[a-z]{2,3}:)?")
_JOINED = regex.compile(rf"{TOKEN}(?:~{TOKEN})*")


@dataclass
class Section:
    id: str
    parent: str | None
    depth: int
    ordinal: int
    line: int
    ref: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    dictionary: dict[str, str] = field(default_factory=dict)
    blocks: list[dict] = field(default_factory=list)


def _value(text: str) -> str:
    """A metadata value as JSON text."""
    text = text.strip()
    if text.startswith("'") and text.endswith("'") and len(text) > 1:
        return '"' + text[1:-1].replace("\\", "\\\\").replace('"', '\\"') + '"'
    return text if re.fullmatch(r'"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|true|false|\[.*\]', text) else '"' + text.replace('"', '\\"') + '"'


def parse(text: str) -> tuple[list[Section], list[dict]]:
    """Sections in file order, the root first, and errors with their lines (from 1)."""
    sections: list[Section] = []
    errors: list[dict] = []
    open_ids: list[tuple[int, str]] = []
    mode, block = "", None

    def close(end: int) -> None:
        nonlocal block
        if block is not None:
            block["end_line"] = end
            block["raw"] = "\n".join(block.pop("lines")).strip("\n")
            block = None

    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        if m := _HEADING.match(line):
            close(n - 1)
            mode, depth, name = "", len(m[1]), m[2]
            while open_ids and open_ids[-1][0] >= depth:
                open_ids.pop()
            parent = open_ids[-1][1] if open_ids else None
            ref = name[1:-1] if name.startswith("<") and name.endswith(">") else None
            full = name if parent is None else f"{parent}.{name}"
            if depth > 1 and parent is None:
                errors.append({"line": n, "message": "section without a document"})
            if depth == 1 and sections:
                errors.append({"line": n, "message": "second document heading"})
            sections.append(Section(full, parent, depth, len(sections), n, ref))
            open_ids.append((depth, full))
        elif line.strip() in ("[metadata]", "[metadata.dictionary]") and sections:
            close(n - 1)
            mode = "dictionary" if "dictionary" in line else "metadata"
        elif line.startswith("{#"):
            close(n - 1)
            mode, m = "", _TAG.match(line)
            if m is None:
                errors.append({"line": n, "message": "malformed block tag"})
            if not sections:
                errors.append({"line": n, "message": "block without a document"})
                continue
            values = {k: _value(v) for k, v in _PAIR.findall(m[2])} if m else {}
            block = {"id": m[1] if m else "", "metadata": values, "start_line": n, "lines": []}
            sections[-1].blocks.append(block)
        elif mode and line.strip():
            m = _ASSIGN.match(line)
            if m is None:
                errors.append({"line": n, "message": "malformed metadata"})
            elif mode == "dictionary":
                sections[-1].dictionary[m[1].strip('"')] = m[2].strip().strip('"')
            else:
                sections[-1].metadata[m[1].strip('"')] = _value(m[2])
        elif line.strip():
            if not sections:
                errors.append({"line": n, "message": "text before the document heading"})
            else:
                if block is None:
                    block = {"id": "", "metadata": {}, "start_line": n, "lines": []}
                    sections[-1].blocks.append(block)
                block["lines"].append(line)
        else:
            mode = ""
            if block is not None:
                block["lines"].append(line)
    close(len(lines))
    if not sections:
        errors.append({"line": 1, "message": "no document heading"})
    return sections, errors


def _stream(raw: str, edited: bool) -> list[tuple[str, str | None, str | None, int]]:
    """The characters that are read, each with its exemption, its [w:] value and its place in raw."""
    out: list[tuple[str, str | None, str | None, int]] = []
    frames: list[tuple[str, str | None]] = []  # what closes it, its exemption
    i, n = 0, len(raw)

    def put(c: str, at: int, word: str | None = None) -> None:
        out.append((c, next((e for _, e in reversed(frames) if e), None), word, at))

    while i < n:
        if m := _PLAIN.match(raw, i):
            exemption = next((e for _, e in reversed(frames) if e), None)
            out.extend([(x, exemption, None, at) for at, x in enumerate(m[0], i)])
            i = m.end()
            continue
        c = raw[i]
        if c == "\\" and i + 1 < n:
            put(raw[i + 1], i + 1)
            i += 2
        elif raw.startswith("<<", i) and (end := raw.find(">>", i)) > 0:
            i = end + 2
        elif c == "<" and (m := _TAGGED.match(raw, i)):
            i = m.end()
        elif m := _PAGE.match(raw, i):
            i = m.end()
        elif m := _WORD.match(raw, i):
            value = re.sub(r"\\(.)", r"\1", m[2]).replace("~", " ")
            for k, x in enumerate(m[1]):
                put(x, m.start(1) + k, value)
            i = m.end()
        elif m := _EDIT.match(raw, i):
            if (m[1] == "+") == edited:
                for x, _, w, at in _stream(m[2], edited):
                    put(x, m.start(2) + at, w)
            i = m.end()
        elif m := _OPEN.match(raw, i):
            frames.append(("]", _FRAME[m[1]]))
            i = m.end()
        elif c == "[":
            frames.append(("]", "citation"))
            put(" ", i)
            i += 1
        elif c == "]" and any(f[0] == "]" for f in frames):
            while frames.pop()[0] != "]":
                pass
            i += 1
        elif c == "$":
            if any(f[0] == "$" for f in frames):
                while frames.pop()[0] != "$":
                    pass
                i += 1
            else:
                m = _SPOKEN.match(raw, i)
                frames.append(("$", "language"))
                i = m.end()
        elif c in "_*{}":
            i += 1
        else:
            put(c, i)
            i += 1
    return out


def _read(raw: str, edited: bool) -> list[dict]:
    body = re.sub(r"(?m)^(\^\d+ |> ?|- |\|)", lambda m: " " * len(m[0]), raw).replace("|", " ") if re.search(r"(?m)^[>|^-]", raw) else raw
    stream = _stream(body, edited)
    text = "".join(c for c, *_ in stream)
    found = []
    for m in _JOINED.finditer(text):
        first, last = stream[m.start()], stream[m.end() - 1]
        found.append({"text": m[0].replace("~", " "), "exemption": first[1], "word": first[2], "start": first[3], "end": last[3] + 1})
    return found


def tokens(raw: str, original: bool = True) -> list[dict]:
    """Tokens of a block: the edited version's, then what the original, if asked for, has beyond them (counts respected)."""
    edited = _read(raw, True)
    other = _read(raw, False) if original and ("[-" in raw or "[+" in raw) else []  # without edits the two are equal
    key = lambda t: (t["text"], t["exemption"], t["word"])
    left = Counter(map(key, edited))
    extra = []
    for t in other:
        if left[key(t)] > 0:
            left[key(t)] -= 1
        else:
            extra.append(t)
    return [t | {"version": "edited"} for t in edited] + [t | {"version": "original"} for t in extra]


SECTION = "struct<id string, parent string, depth int, ordinal int, line int, ref string, metadata map<string, string>, dictionary map<string, string>, blocks array<struct<id string, metadata map<string, string>, raw string, start_line int, end_line int>>>"
_TEXTS = pa.map_(pa.string(), pa.string())
_BLOCK = pa.struct([("id", pa.string()), ("metadata", _TEXTS), ("raw", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])
_SECTIONS = pa.list_(pa.struct([("id", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("ordinal", pa.int32()), ("line", pa.int32()), ("ref", pa.string()), ("metadata", _TEXTS), ("dictionary", _TEXTS), ("blocks", pa.list_(_BLOCK))]))
_ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))
PARSED = f"path string, text string, errors array<struct<line int, message string>>, sections array<{SECTION}>"


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, text) with errors and sections; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = lambda row, *keys: row | {k: list(row[k].items()) for k in keys}
        for batch in batches:
            found = [parse(t or "") for t in batch.column("text").to_pylist()]
            sections = [[maps(vars(s), "metadata", "dictionary") | {"blocks": [maps(b, "metadata") for b in s.blocks]} for s in ss] for ss, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("text"), pa.array([e for _, e in found], _ERRORS), pa.array(sections, _SECTIONS)], names=["path", "text", "errors", "sections"])

    return files.select("path", "text").mapInArrow(run, PARSED)


def sections_of(parsed: DataFrame, inherited: bool = False) -> DataFrame:
    """One row per section, with the ids of its ancestors from the root; if so asked, with the metadata keys that
    it or an ancestor in its own file holds (borrowed children hold none)."""
    own = F.transform(F.filter("sections", lambda s: s["ref"].isNull()), lambda s: F.named_struct(F.lit("id"), s["id"], F.lit("keys"), F.map_keys(s["metadata"])))
    held = [own.alias("held")] if inherited else []
    rows = parsed.select("path", *held, F.explode("sections").alias("s")).select("path", *[F.col("held") for _ in held], "s.*")
    parts = F.split("parent", r"\.")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(n - F.col("depth") + 2, n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    rows = rows.withColumn("ancestors", F.when(F.col("parent").isNull(), F.array().cast("array<string>")).otherwise(prefixes))
    if not inherited:
        return rows
    above = F.filter("held", lambda h: (h["id"] == F.col("id")) | F.array_contains("ancestors", h["id"]))
    return rows.withColumn("inherited", F.flatten(F.transform(above, lambda h: h["keys"]))).drop("held")


def blocks_of(parsed: DataFrame) -> DataFrame:
    """One row per block, in file order."""
    rows = parsed.select("path", F.explode("sections").alias("s")).select("path", F.col("s.id").alias("section_id"), F.posexplode("s.blocks").alias("block_ordinal", "b"))
    return rows.select("path", "section_id", "block_ordinal", F.col("b.id").alias("block_id"), "b.metadata", "b.raw", "b.start_line", "b.end_line")


_TOKENS = "pos int, version string, text string, exemption string, word string, start int, end int, line int"


def tokens_of(blocks: DataFrame) -> DataFrame:
    """One row per token of blocks, with its version, exemption, [w:] value and line."""
    return tokens_in_blocks(blocks).select("path", "section_id", "block_ordinal", F.inline("tokens"))


_TOKEN = pa.struct([("pos", pa.int32()), ("version", pa.string()), ("text", pa.string()), ("exemption", pa.string()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32())])


def tokens_in_blocks(blocks: DataFrame, original: bool = True) -> DataFrame:
    """One row per block with its tokens as an array, so that blocks need not be put together again; the edited version's alone if so asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [t | {"pos": k, "line": line + 1 + raw.count("\n", 0, t["start"])} for k, t in enumerate(tokens(raw, original))]
                for raw, line in zip(batch.column("raw").to_pylist(), batch.column("start_line").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + [pa.array(rows, pa.list_(_TOKEN))], names=["path", "section_id", "block_ordinal", "tokens"])

    return blocks.select("path", "section_id", "block_ordinal", "raw", "start_line").mapInArrow(run, f"path string, section_id string, block_ordinal int, tokens array<struct<{_TOKENS}>>")
