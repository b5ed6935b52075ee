"""Mining of lexicons from marked-up spans, and suggestions for text that has no mark-up yet.

The strength of a language word is a documented choice: a word marked in a language is weak
there if it stands unmarked at least as often as marked, else strong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import small

LONE_LETTERS = 4


def phrase_lexicon(spans: DataFrame) -> DataFrame:
    """type, phrase, files that hold it and spans, from spans(path, type, phrase); one-letter phrases don't count."""
    return spans.filter(F.char_length("phrase") > 1).groupBy("type", "phrase").agg(F.countDistinct("path").alias("files"), F.count("*").alias("n"))


def language_lexicon(counts: DataFrame) -> DataFrame:
    """lang, word, marked, unmarked and strength from counts (lang, word, n); a null lang counts unmarked words. One shuffle, by word."""
    of = F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n")))
    plain = F.coalesce(F.sum(F.when(F.col("lang").isNull(), F.col("n"))), F.lit(0))
    words = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).groupBy("word").agg(of.alias("of"), plain.alias("unmarked"))
    out = words.select(F.explode("of").alias("m"), "word", "unmarked").select("m.lang", "word", F.col("m.n").alias("marked"), "unmarked")
    return out.withColumn("strength", F.when(F.col("unmarked") >= F.col("marked"), "weak").otherwise("strong"))


def with_overrides(lexicon: DataFrame, overrides: DataFrame) -> DataFrame:
    """The lexicon with strengths set by hand: strong, weak, or ignore."""
    named = overrides.select("lang", "word", F.col("strength").alias("_set"))
    out = lexicon.join(named, ["lang", "word"], "full")
    return out.withColumn("strength", F.coalesce("_set", "strength")).filter("strength <> 'ignore'").drop("_set")


def language_clusters(texts: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Runs of neighbouring words (texts: key, words) in a language's lexicon with a strong one among them;
    a run of one needs LONE_LETTERS letters.

    Words meet the lexicon where they are if it is small; hits are gathered in each task before
    they move, so what is shuffled is a row for each text and language. A hit's island is its
    place less its rank, within the row.
    """
    words = texts.select(key, F.posexplode("words").alias("pos", "word"))
    held = words.join(small(lexicon.select("lang", "word", "strength")), "word")
    strong = F.when(F.col("strength") == "strong", F.char_length("word")).otherwise(0)
    rows = held.groupBy(key, "lang").agg(F.sort_array(F.collect_list(F.struct("pos", strong.alias("strong")))).alias("hits"))
    islands = F.transform("hits", lambda h, i: F.struct((h["pos"] - i).alias("island"), h["pos"].alias("pos"), h["strong"].alias("strong")))
    runs = rows.select(key, "lang", F.inline(islands)).groupBy(key, "lang", "island").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), F.max("strong").alias("longest")
    )
    return runs.filter((F.col("longest") > 0) & ((F.col("n") > 1) | (F.col("longest") >= LONE_LETTERS))).drop("island", "longest")


def word_runs(most: int) -> Column:
    """All runs of 1 to most words of a row's words: array<struct<start, words, phrase>>."""

    def placed(n: int) -> Callable[[Column, Column], Column]:
        return lambda g, i: F.struct(i.alias("start"), F.lit(n).alias("words"), g.alias("phrase"))

    grams, each = F.col("words"), []
    for n in range(1, most + 1):
        if n > 1:
            further = F.when(F.size("words") >= n, F.slice("words", F.lit(n), F.greatest(F.size("words") - n + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
            grams = F.zip_with(grams, further, lambda a, b: F.concat(a, F.lit(" "), b))
        each.append(F.transform(grams, placed(n)))
    return F.concat(*each)


def longest_phrases(texts: DataFrame, phrases: DataFrame, key: str, most: int) -> DataFrame:
    """Phrases of at most so many words found in texts (key, words): the longest at a place, then from the left,
    none inside another. Runs of words are built within a row and meet the phrases where they are if those are small."""
    wanted = phrases.select("phrase").distinct()
    runs = texts.select(key, F.inline(word_runs(most))).filter("phrase is not null")
    found = runs.join(small(wanted), "phrase", "left_semi")
    longest = found.groupBy(key, "start").agg(F.max_by("phrase", "words").alias("phrase"), F.max("words").alias("words"))
    reach = F.max(F.col("start") + F.col("words")).over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return longest.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("start") + F.col("words") > F.col("reach"))).drop("reach")


def grouped(suggestions: DataFrame) -> DataFrame:
    """Suggestions by type, language and text, with how many there are, most first, then by text."""
    out = suggestions.groupBy("type", "lang", "text").agg(F.count("*").alias("n"))
    return out.orderBy(F.col("n").desc(), "text", "type", "lang")


def outermost(spans: DataFrame, key: str) -> DataFrame:
    """Suggestions (key, start, end) without those that lie inside another of the same key; of equal ones the first type stays."""
    order = Window.partitionBy(key).orderBy("start", F.col("end").desc(), "type")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


#: A locator of a citation, and a cue before a title.
LOCATOR = r"\b(?:Sect|Lib|Cap|Chap|Book|Vol|Part|Ch|Art)\.? (?:[IVXLCDM]+|\d+)\b\.?"
CUE = r"\b(?:See|Vid|Vide|Cf)\.? (?:\p{Lu}[\p{L}'’.]*(?: |$)){1,4}"


def citation_patterns(lines: DataFrame, key: str) -> DataFrame:
    """key, line and text of locators and cues in lines without mark-up."""
    found = F.concat(F.regexp_extract_all("text", F.lit(LOCATOR), F.lit(0)), F.regexp_extract_all("text", F.lit(CUE), F.lit(0)))
    return lines.filter(~F.col("text").contains("[")).select(key, "line", F.explode(found).alias("text"))
