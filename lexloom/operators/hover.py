"""What a reader sees of a word: its reading, form, lemma and other readings; and the rules for entries typed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.words import entry_words, fold, is_mechanical, possessive_base
from lexloom.operators.register import by_surface, select_reading
from lexloom.session import settled, small


def hover(shown: DataFrame, expanded: DataFrame, overrides: DataFrame) -> DataFrame:
    """shown(display) with status, surface, lemma, form, clitic, ambiguous, overridden and others.

    overrides(surface, value) hold for the text. A surface without an entry is looked up by its
    possessive base; the two lookups are two equality joins. A value that selects another reading
    is its lemma, else its spelling, else none.
    """
    of = small(by_surface(expanded))
    rows = shown.withColumn("surface", fold(F.col("display"))).withColumn("base", possessive_base(F.col("surface")))
    rows = rows.join(of.withColumnRenamed("of", "direct"), "surface", "left").join(of.select(F.col("surface").alias("base"), F.col("of").alias("by_base")), "base", "left")
    rows = rows.join(small(overrides.select("surface", F.col("value").alias("override"))), "surface", "left")
    rows = rows.withColumn("entry", F.coalesce("direct", "by_base")).withColumn("possessive", F.col("direct").isNull() & F.col("by_base").isNotNull())
    picked = select_reading(F.col("entry"), F.col("override"))
    rows = rows.withColumn("reading", F.coalesce(picked, F.get("entry", F.lit(0))))
    status = F.when(F.col("entry").isNotNull(), F.when(F.col("possessive"), "possessive").otherwise("registered")).when(is_mechanical(F.col("display")), "mechanical").otherwise("unaccounted")

    def pin(r: Column) -> Column:
        one = lambda v: F.size(F.filter("entry", lambda x: (x["spelling"] == v) | (x["lemma"] == v))) == 1
        return F.when(~F.col("possessive") & one(r["lemma"]), r["lemma"]).when(~F.col("possessive") & one(r["spelling"]), r["spelling"])

    others = F.transform(F.filter("entry", lambda r: r != F.col("reading")), lambda r: F.struct(r["lemma"].alias("lemma"), r["spelling"].alias("spelling"), pin(r).alias("value")))
    return rows.select(
        "display", "surface", status.alias("status"), F.col("reading.lemma").alias("lemma"), F.col("reading.spelling").alias("form"),
        F.when(F.col("possessive"), F.substr("surface", F.char_length("base") + 1)).alias("clitic"),
        (F.size("entry") >= 2).alias("ambiguous"), F.coalesce(picked == F.col("reading"), F.lit(False)).alias("overridden"), others.alias("others"),
    )


def _one_word(text: Column) -> Column:
    words = entry_words(text)
    return F.when(F.size(words) == 1, words[0])


def _entry(surface: Column, value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), surface).alias("surface"), F.when(error.isNull(), value).alias("value"), error.alias("error"))


def lemma_entry(text: Column) -> Column:
    surface = _one_word(text)
    return _entry(surface, F.lit(None).cast("string"), F.when(surface.isNull(), "Enter a single word for the lemma."))


def form_entry(lemma: Column, text: Column) -> Column:
    surface, folded = _one_word(text), F.array_join(entry_words(lemma), " ")
    error = F.when(surface.isNull(), "Enter a single word for the form.").when(surface == folded, "A form must differ from its lemma.")
    return _entry(surface, F.concat(F.lit("="), folded), error)


def variant_entry(text: Column, spelling: Column) -> Column:
    surface, words = _one_word(text), entry_words(spelling)
    error = (
        F.when(surface.isNull(), "Enter a single word for the variant spelling.").when(F.size(words) == 0, "Enter the modern spelling (one or more words).")
        .when((F.size(words) == 1) & (words[0] == surface), "A variant must point at a different spelling.")
    )
    return _entry(surface, F.array_join(words, " "), error)


def removable(rows: DataFrame) -> DataFrame:
    """Surfaces and whether their entry may be removed as a whole: not with several readings."""
    return rows.groupBy("surface").agg((F.count("*") < 2).alias("removable"))


def targets(wanted: DataFrame, entries: DataFrame, attested: DataFrame, kind: str) -> DataFrame:
    """wanted(target) with what adding it needs: resolved; for a spelling prompt or reject, for a lemma add or confirm."""
    yes, no = ("prompt", "reject") if kind == "spelling" else ("add", "confirm")
    known = entries.select(F.col("surface").alias("target"), F.lit(True).alias("_known")).distinct()
    seen = attested.select(F.col("surface").alias("target"), F.lit(True).alias("_seen")).distinct()
    return wanted.join(known, "target", "left").join(seen, "target", "left").select("target", F.when(F.col("_known"), "resolved").when(F.col("_seen"), yes).otherwise(no).alias("state"))


def cascade(wanted: DataFrame, entries: DataFrame, offered: DataFrame) -> DataFrame:
    """All entries that adding wanted(surface, spellings, lemma) brings with it, from offered entries of the same
    columns, each once with the round it is needed in; what is registered already ends a branch. Rounds go on until none is new."""
    known = entries.select("surface").distinct()
    front = settled(wanted.select("surface", "spellings", "lemma").join(known, "surface", "left_anti"))
    out, k = front.withColumn("round", F.lit(0)), 0
    while not front.isEmpty():
        k += 1
        named = front.select(F.explode(F.coalesce("spellings", F.array("lemma"))).alias("surface")).distinct()
        fresh = offered.select("surface", "spellings", "lemma").join(named, "surface", "left_semi").join(known, "surface", "left_anti").join(out.select("surface"), "surface", "left_anti")
        front = settled(fresh)
        out = out.unionByName(front.withColumn("round", F.lit(k)))
    return out
