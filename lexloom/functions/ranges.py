"""Places in sources: text between two places, spans in braces, tokens that stand on their own characters."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_BRACES = regex.compile(r"\\.|(\{\{(?:\\.|(?!\}\}).)*(?:\}\}|$)|\{(?:\\.|[^}\\])*(?:\}|$))", regex.S)


def slice_range(lines: Column, from_line: Column, from_col: Column, to_line: Column, to_col: Column) -> Column:
    """Text from one place to another (from 0, the end outside): the first line's tail, whole lines, the last line's head."""
    at = lambda n: F.coalesce(F.get(lines, n), F.lit(""))
    one = F.substr(at(from_line), from_col + 1, F.greatest(to_col - from_col, F.lit(0)))
    between = F.slice(lines, from_line + 2, F.greatest(to_line - from_line - 1, F.lit(0)))
    many = F.concat(F.array(F.substr(at(from_line), from_col + 1)), between, F.array(F.substr(at(to_line), F.lit(1), to_col)))
    return F.when(from_line == to_line, one).otherwise(F.array_join(many, "\n"))


def brace_spans(line: str) -> list[tuple[int, int]]:
    """Where {...} and {{...}} stand in a line; escaped braces are text, an open one ends with the line."""
    return [m.span(1) for m in _BRACES.finditer(line) if m[1] is not None]


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def widen_over_braces(line: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """A token's place, widened over braces that it reaches into. Spark has no function that gives matches' places."""
    out = []
    for text, a, b in zip(line, start, end, strict=True):
        for lo, hi in brace_spans(text or ""):
            if hi > a and lo < b:
                a, b = min(a, lo), max(b, hi)
        out.append((a, b))
    return pd.DataFrame(out, columns=["start", "end"])


def anchored(line: Column, start: Column, end: Column, shown: Column) -> Column:
    """Whether a token's place begins and ends with the characters it is shown with."""
    first, last = F.substr(line, start + 1, F.lit(1)), F.substr(line, end, F.lit(1))
    return (first == F.left(shown, F.lit(1))) & (last == F.right(shown, F.lit(1)))
