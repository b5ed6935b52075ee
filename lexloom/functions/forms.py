"""What is wrong with a value typed into a form; null where it is right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.paths import YEAR

#: The messages of the forms.
SLUG_ERROR = "Must be a lowercase slug (a-z, 0-9)"
YEAR_SLUG_ERROR = "Must be a year slug (1748, 1742a, 1739-40)"
YEAR_ERROR = "Must be a year (number)"
REQUIRED = "Required"


def slug_error(text: Column) -> Column:
    return F.when(~text.rlike("^[a-z0-9]+$"), SLUG_ERROR)


def year_slug_error(text: Column) -> Column:
    return F.when(~text.rlike(YEAR), YEAR_SLUG_ERROR)


def year_error(text: Column) -> Column:
    return F.when(~F.trim(text).rlike(r"^\d+$"), YEAR_ERROR)


def required_error(text: Column) -> Column:
    return F.when(F.trim(text) == "", REQUIRED)


def identifier_error(text: Column, pattern: str, shape: str) -> Column:
    return F.when(~F.trim(text).rlike(pattern), F.lit(f"Must be {shape}"))
