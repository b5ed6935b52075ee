"""The canonical form of a marked-up source, and a sweep over many.

The form is reconstructed from how sources are written: no blanks at line ends, one blank line at most
between parts, none at the start, one newline at the end, single blanks around a metadata assignment and a tag's commas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """The text in canonical form; a null text is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]+(?=\n|\z)", "")
    out = F.regexp_replace(out, r"(?m)^(\w+)[ \t]*=[ \t]*(?=[\"'\[{\-\d]|true$|false$)", "$1 = ")
    out = F.regexp_replace(out, r"(?m)^(#{1,6})[ \t]+", "$1 ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"\A\n+|\n+\z", "")
    return F.when(out == "", out).otherwise(F.concat(out, F.lit("\n")))


def sweep(files: DataFrame) -> DataFrame:
    """path, formatted text and changed for every file."""
    formatted = canonical(F.col("text"))
    return files.select("path", formatted.alias("formatted"), (formatted != F.coalesce("text", F.lit(""))).alias("changed"))


def summary(swept: DataFrame) -> DataFrame:
    """How many files there are and how many the sweep changes."""
    return swept.agg(F.count("*").alias("total"), F.count(F.when(F.col("changed"), 1)).alias("changed"))
