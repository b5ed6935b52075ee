"""Accounting of tokens against a register: statuses, coverage, indices, the curation backlog.

Tokens are summed by surface before any join, so a join's rows are vocabulary, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.words import fold_token, is_mechanical, possessive_base, tokens
from lexloom.session import small


def token_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each token: kept columns, pos, text and its folded surface."""
    out = docs.select(*keep, F.posexplode(tokens(F.col("text"))).alias("pos", "text"))
    return out.withColumn("surface", fold_token(F.col("text")))


def surface_counts(docs: DataFrame, *by: str) -> DataFrame:
    """n tokens of each surface (within by); partial sums come before the shuffle."""
    surface = F.transform(tokens(F.col("text")), fold_token)
    return docs.select(*by, F.explode(surface).alias("surface")).groupBy(*by, "surface").agg(F.count("*").alias("n"))


def register_of(texts: DataFrame) -> DataFrame:
    """The distinct surfaces of texts, as a register without readings."""
    return surface_counts(texts).select("surface")


def status(exempt: Column, registered: Column, possessive: Column, surface: Column) -> Column:
    """exempt, then registered, possessive, mechanical, unaccounted."""
    return F.when(exempt, "exempt").when(registered, "registered").when(possessive, "possessive").when(is_mechanical(surface), "mechanical").otherwise("unaccounted")


def with_status(counts: DataFrame, register: DataFrame) -> DataFrame:
    """counts (with surface, and exempt if any token is) with the status of each surface.

    Two equality joins: one on the surface, one on the possessive base. One join with OR
    would be a nested loop.
    """
    entries = small(register.select("surface").distinct())
    direct = entries.select("surface", F.lit(True).alias("_direct"))
    base = entries.select(F.col("surface").alias("_base"), F.lit(True).alias("_by_base"))
    exempt = F.col("exempt") if "exempt" in counts.columns else F.lit(False)
    return (
        counts.withColumn("_base", possessive_base(F.col("surface")))
        .join(direct, "surface", "left")
        .join(base, "_base", "left")
        .withColumn("status", status(exempt, F.col("_direct").isNotNull(), F.col("_by_base").isNotNull(), F.col("surface")))
        .drop("_base", "_direct", "_by_base")
    )


def coverage(counts: DataFrame, by: str | None = None) -> DataFrame:
    """total, accounted and unaccounted tokens; with by, a row for each value and one for all (null)."""
    sums = [
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("status") != "unaccounted", F.col("n")).otherwise(0)).alias("accounted"),
        F.sum(F.when(F.col("status") == "unaccounted", F.col("n")).otherwise(0)).alias("unaccounted"),
    ]
    return counts.rollup(by).agg(*sums) if by else counts.agg(*sums)


def token_index(docs: DataFrame, key: str) -> DataFrame:
    """candidates (tokens that are not mechanical) and the first document for each surface."""
    surface = F.transform(tokens(F.col("text")), fold_token)
    rows = docs.select(key, F.explode(surface).alias("surface")).filter(~is_mechanical(F.col("surface")))
    return rows.groupBy("surface").agg(F.count("*").alias("candidates"), F.min(key).alias("example"))


def document_surfaces(docs: DataFrame, key: str) -> DataFrame:
    """For each document and surface: candidates and the first line (from 1) that has it."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    rows = lines.select(key, (F.col("line") + 1).alias("line"), F.explode(F.transform(tokens(F.col("text")), fold_token)).alias("surface"))
    return rows.filter(~is_mechanical(F.col("surface"))).groupBy(key, "surface").agg(F.count("*").alias("candidates"), F.min("line").alias("line"))


def backlog(index: DataFrame, register: DataFrame) -> DataFrame:
    """Unaccounted surfaces with their counts and examples."""
    found = with_status(index.withColumnRenamed("candidates", "n"), register)
    return found.filter("status = 'unaccounted'").select("surface", "n", "example")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k most frequent surfaces, ties by surface, with the number there are in all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.col("n").desc(), "surface").limit(k).crossJoin(F.broadcast(total))  # total is one row


def page(rows: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page of the ranking, or the last one where there are fewer; only the rows up to the page are sorted and counted."""
    first = rows.orderBy(F.col("n").desc(), "surface").limit((max(number, 0) + 1) * size)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "surface"))
    last = F.ceil(F.count("*").over(Window.partitionBy()) / size) - 1
    ranked = first.withColumns({"rank": rank, "_last": last})
    return ranked.filter(F.col("rank") > F.least(F.lit(max(number, 0)), "_last") * size).drop("_last")
