"""Taking marked-up texts from TEI files: where they come from, what they turn into, and what the plan is."""

from __future__ import annotations

import re
import xml.etree.ElementTree as xml

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Why an import is declined.
HELD = "This edition already holds text. Import into an empty stub, or clear the existing text first."
NOTHING = "converted to nothing"


def first_root(folders: DataFrame, files: DataFrame) -> DataFrame:
    """The first folder (by ord) with author files below data/authors."""
    held = files.select(F.regexp_extract("path", r"^(.*)/data/authors/", 1).alias("folder"), F.col("path").contains("/data/authors/").alias("_in")).filter("_in").select("folder").distinct()
    return folders.join(held, "folder", "left_semi").orderBy("ord").limit(1).select("folder")


def fetched(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted (id) with the store's xml, or the reason why there is none. The store is any table of id and xml: files, or what a fetcher brought."""
    out = wanted.join(store.select("id", "xml"), "id", "left")
    return out.withColumns({"ok": F.col("xml").isNotNull(), "reason": F.when(F.col("xml").isNull(), "notFound")})


def _name(e: xml.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: xml.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def tei_to_marked(source: str | None) -> str:
    """Divisions as sections, paragraphs, verse lines and speeches as blocks, under a heading of the converter's; broken XML gives nothing."""
    try:
        root = xml.fromstring(source or "")
    except xml.ParseError:
        return ""
    out = ["# TEXT", "", "[metadata]", 'title = "TEXT"', ""]

    def walk(e: xml.Element, depth: int) -> None:
        sections = blocks = 0
        for child in e:
            name = _name(child)
            if name.startswith("div"):
                sections += 1
                out.extend(["#" * min(depth + 1, 6) + f" {sections}", ""])
                walk(child, depth + 1)
            elif name in ("p", "l", "sp", "head", "ab"):
                if text := _text(child):
                    blocks += 1
                    out.extend([f"{{#{blocks}}}", text, ""])
            else:
                walk(child, depth)

    body = next((e for e in root.iter() if _name(e) == "body"), None)
    if body is None:
        return ""
    walk(body, 1)
    return "\n".join(out)


@F.pandas_udf(StringType())
def converted(source: pd.Series) -> pd.Series:
    return source.map(tei_to_marked)


def without_root(marked):
    """A converted text without its own heading and metadata."""
    return F.regexp_replace(marked, r"\A#[^\n]*\n(?:\s*\[metadata[^\]]*\]\n(?:[^\n]+\n?)*)*\s*", "")


def import_plan(stubs: DataFrame, store: DataFrame) -> DataFrame:
    """stubs (path, id, text) with kind (declined or ready), message and the text as it would be: only empty stubs take text."""
    rows = fetched(stubs, store).withColumn("fragment", F.when(F.col("ok"), without_root(converted(F.col("xml")))))
    held = F.col("text").rlike(r"(?m)^(?:\{#|##)")
    message = (
        F.when(held, HELD).when(~F.col("ok"), F.format_string("There is no text for %s.", "id")).when(F.trim("fragment") == "", F.format_string(f"%s {NOTHING}.", "id"))
    )
    whole = F.concat(F.regexp_replace("text", r"\s+\z", ""), F.lit("\n\n"), F.col("fragment"))
    return rows.select("path", "id", F.when(message.isNull(), "ready").otherwise("declined").alias("kind"), message.alias("message"), F.when(message.isNull(), whole).alias("document"))
