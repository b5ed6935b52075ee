"""Occurrences of unaccounted words in sources, and the longer units they could belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.words import fold
from lexloom.operators.accounting import with_status
from lexloom.session import small


def unaccounted(tokens: DataFrame, register: DataFrame) -> DataFrame:
    """Distinct surfaces of tokens (surface, exemption) that no register entry, possessive or numeral covers."""
    counts = tokens.filter("exemption is null").groupBy("surface").agg(F.count("*").alias("n"))
    return with_status(counts, register).filter("status = 'unaccounted'").select("surface")


def multi_word_surfaces(register: DataFrame) -> DataFrame:
    return register.filter(F.contains("surface", F.lit(" "))).select("surface").distinct()


def occurrences(tokens: DataFrame, register: DataFrame, most: int = 4) -> DataFrame:
    """occurrences_in_blocks of tokens, one a row, with path, section_id, block_ordinal, pos, text, exemption, version, word and line."""
    key = ["path", "section_id", "block_ordinal"]
    blocks = tokens.groupBy(*key).agg(F.collect_list(F.struct("pos", "version", "text", "exemption", "word", "line")).alias("tokens"))
    return occurrences_in_blocks(blocks, register, most)


def occurrences_in_blocks(blocks: DataFrame, register: DataFrame, most: int = 4) -> DataFrame:
    """Each unaccounted token with the longest registered unit of up to most words around it (then the leftmost), or null.

    blocks has path, section_id, block_ordinal and tokens; only the edited version's tokens outside
    exempting mark-up count. Units run over neighbouring tokens of a block. A token takes the units that it
    could stand in along, so each is one equality join with the register's units, and blocks need not be put together again.
    """
    plain = F.filter("tokens", lambda t: (t["version"] == "edited") & t["exemption"].isNull() & t["word"].isNull())
    plain = F.array_sort(F.transform(plain, lambda t: F.struct(t["pos"].alias("pos"), t["text"].alias("text"), t["line"].alias("line"), fold(t["text"]).alias("surface"))))
    rows = blocks.select("path", "section_id", plain.alias("plain"))
    rows = rows.select("path", "section_id", F.transform("plain", lambda t: t["pos"]).alias("places"), F.transform("plain", lambda t: t["surface"]).alias("surfaces"), F.posexplode("plain").alias("at", "t"))
    lost = with_status(rows.select("path", "section_id", "places", "surfaces", "at", "t.*"), register).filter("status = 'unaccounted'")
    spans = [(n, back) for n in range(most, 1, -1) for back in range(n - 1, -1, -1)]  # the longest first, then the leftmost

    def unit(n: int, back: int) -> Column:
        first = F.col("at") - back
        fits = (first >= 0) & (F.get("places", first + (n - 1)) == F.get("places", first) + (n - 1))
        return F.when(fits, F.array_join(F.slice("surfaces", F.greatest(first, F.lit(0)) + 1, F.lit(n)), " "))

    told = lost.select("path", "section_id", "line", "pos", "text", "surface", *[unit(n, back).alias(f"_u{k}") for k, (n, back) in enumerate(spans)])
    held = small(multi_word_surfaces(register))
    for k in range(len(spans)):
        told = told.join(held.select(F.col("surface").alias(f"_u{k}"), F.lit(True).alias(f"_held{k}")), f"_u{k}", "left")
    fuse = F.coalesce(*[F.when(F.col(f"_held{k}"), F.col(f"_u{k}")) for k in range(len(spans))])
    return told.select("path", "section_id", "line", "pos", "text", "surface", fuse.alias("fuse"))
