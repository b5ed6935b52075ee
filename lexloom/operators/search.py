"""Search over lines, with scope and caps, and planning of replacements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_FILE, OVERALL = 500, 10_000
BEFORE, AROUND = 48, 120


@dataclass(frozen=True)
class Query:
    term: str
    is_regex: bool = False
    case_sensitive: bool = False
    whole_word: bool = False
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())


def pattern_of(query: Query) -> str:
    """The query as a pattern for Java's and Python's regex; a bad one raises ValueError with the reason."""
    source = f"(?:{query.term})" if query.is_regex else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query.term)
    if query.whole_word:
        source = rf"(?<![\p{{L}}\p{{N}}]){source}(?![\p{{L}}\p{{N}}])"
    try:
        regex.compile(source)
    except regex.error as error:
        raise ValueError(str(error)) from error
    return source if query.case_sensitive else f"(?iu){source}"


def scoped(editions: DataFrame, query: Query) -> DataFrame:
    """Editions with an included author (or any) and no excluded one; each source once."""
    clean = lambda xs: [x.strip().lower() for x in xs if x.strip()]
    inside, outside = clean(query.include), clean(query.exclude)
    if inside:
        editions = editions.filter(F.arrays_overlap("author_slugs", F.array(*map(F.lit, inside))))
    if outside:
        editions = editions.filter(~F.coalesce(F.arrays_overlap("author_slugs", F.array(*map(F.lit, outside))), F.lit(False)))
    return editions


def searchable_lines(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, line (from 1) and text of block content: no blank lines, no tags."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    spans = blocks.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    return lines.filter((F.trim("text") != "") & ~F.col("text").startswith("{#")).join(spans, ["path", "line"], "left_semi")


def count_matches(text: Column, query: Query) -> Column:
    """Matches that are not empty, in built-in functions."""
    found = F.regexp_extract_all(text, F.lit(pattern_of(query)), F.lit(0))
    return F.size(F.filter(found, lambda m: m != ""))


def positions(lines: DataFrame, query: Query, key: str = "path") -> DataFrame:
    """Each match with its place (code points from 1) and a preview; lines without one are dropped by Java's regex first."""
    pattern = pattern_of(query)
    schema = f"{key} {dict(lines.dtypes)[key]}, line int, start int, end int, match string, preview string"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = regex.compile(pattern)
        for pdf in pdfs:
            rows = [
                (k, n, m.start() + 1, m.end() + 1, m[0], t[max(0, m.start() - BEFORE) : max(0, m.start() - BEFORE) + AROUND])
                for k, n, t in zip(pdf[key], pdf["line"], pdf["text"], strict=True)
                for m in compiled.finditer(t)
                if m[0]
            ]
            yield pd.DataFrame(rows, columns=[key, "line", "start", "end", "match", "preview"])

    return lines.select(key, "line", "text").filter(F.col("text").rlike(pattern)).mapInPandas(run, schema)


def capped(matches: DataFrame, key: str, order: str, per_file: int = PER_FILE, overall: int = OVERALL) -> DataFrame:
    """At most per_file matches of a file and overall in catalogue order, with the file's whole count.

    The running total is over files, one row each, not over matches.
    """
    within = Window.partitionBy(key).orderBy("line", "start")
    ranked = matches.withColumns({"rank": F.row_number().over(within)}).filter(F.col("rank") <= per_file)
    totals = matches.groupBy(key, order).agg(F.count("*").alias("total"))
    taken = totals.select(key, order, F.least("total", F.lit(per_file)).alias("shown"), "total").orderBy(order, key)
    first = taken.limit(overall)  # a file shows one match at least, so no more files can count
    before = F.coalesce(F.sum("shown").over(Window.orderBy(order, key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = first.select(key, "total", before.alias("before")).filter(F.col("before") < overall)
    return ranked.join(room, key).filter(F.col("before") + F.col("rank") <= overall).drop("before")


def replaced(text: Column, query: Query, replacement: str) -> Column:
    """The text with matches replaced; $1 stands for a group in a regex query, and for itself in a literal one."""
    safe = replacement if query.is_regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, F.lit(pattern_of(query)), F.lit(safe))


def replace_plan(targets: DataFrame, lines: DataFrame, query: Query, replacement: str, key: str = "path") -> DataFrame:
    """Targets (key, line, start, end, match) with the text still there or not, and what goes in its place."""
    now = targets.join(lines.select(key, "line", "text"), [key, "line"], "left")
    there = F.substr("text", F.col("start"), F.col("end") - F.col("start"))
    fresh = F.coalesce(there == F.col("match"), F.lit(False))
    return now.select(key, "line", "start", "end", "match", fresh.alias("fresh"), F.when(fresh, replaced(F.col("match"), query, replacement)).alias("replacement"))
