from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.functions import display, paths, words


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("f", [words.fold, words.fold_token])
def test_fold(spark, f):
    assert column(spark, ["THE", "Œconomy", "'Tis", "I", "i", "I'll"], f) == ["the", "œconomy", "'tis", "I", "i", "i'll"]


def test_fold_goes_word_by_word(spark):
    assert column(spark, ["And I Say"], words.fold) == ["and I say"]


def test_is_word(spark):
    good = ["virtue", "'tis", "lookin'", "œconomy", "i.e", "a priori", "to morrow"]
    bad = ["i.e.", "", "1st", "x=y", "fine-day"]
    assert column(spark, good + bad, words.is_word) == [True] * len(good) + [False] * len(bad)


def test_roman_and_mechanical(spark):
    assert column(spark, ["MDCCXL", "xiv", "i", "I", "civil", "", "1739"], words.is_roman) == [True] * 4 + [False] * 3
    assert column(spark, ["1739", "2nd", "xiv", "civil"], words.is_mechanical) == [True, True, True, False]


def test_possessive_base(spark):
    found = column(spark, ["bishop's", "bishop’s", "it's", "bishop", "bishops", "lookin'", "'s"], words.possessive_base)
    assert found == ["bishop", "bishop", "it", None, None, None, None]


def test_shards(spark):
    assert column(spark, ["the", "'tis", "'em", "I", "œconomy", "123"], words.shard_of) == ["t.json", "t.json", "e.json", "i.json", "other.json", "other.json"]


def test_tokens(spark):
    found = column(spark, ["'Tis i.e. self-love king's 3.5 a.b", None, ""], words.tokens)
    assert found == [["'Tis", "i.e", "self", "love", "king's", "3", "5", "a.b"], [], []]


def test_fold_lexical(spark):
    found = column(spark, ["Cædem", "cœur", "J’AIME", "vestrûm", "'tis-", "λόγος", None], words.fold_lexical)
    assert found == ["caedem", "coeur", "j'aime", "vestrum", "tis", "λογος", None]


def test_slugify(spark):
    assert column(spark, ["Fix the Œuvre – Déjà vu!", "one two three four five six seven eight"], words.slugify) == ["fix-the-uvre-deja-vu", "one-two-three-four-five-six"]


def test_entry_words(spark):
    assert column(spark, ["  It   IS ", "bad-word x", "I am"], words.entry_words) == [["it", "is"], [], ["I", "am"]]


def test_paths(spark):
    assert column(spark, ["/a/./b//c", "/a/b/../c", "a/../../b"], paths.normalize_path) == ["/a/b/c", "/a/c", "b"]
    assert column(spark, ["works/hume/thn/1739.mit", "works/hume/thn/index.mit", "authors/hume.mit"], paths.expected_id) == ["hume.thn.1739", "hume.thn", "hume"]
    assert column(spark, ["a.b.<C.D.1750>", "a.b"], paths.borrowed_ref) == ["C.D.1750", None]
    assert column(spark, ["1739", "1739-40", "1740a", "x1"], paths.is_year_slug) == [True, True, True, False]


def test_display(spark):
    df = spark.createDataFrame([(1711, 1776), (None, 1776), (None, None)], "b int, d int")
    assert [r[0] for r in df.select(display.lifespan(F.col("b"), F.col("d"))).collect()] == ["(1711–1776)", "(?–1776)", ""]
    row = spark.range(1).select(
        display.word_markup(F.lit("to morrow"), F.lit("a=b]")).alias("m"), display.wrap_text(F.lit("Will"), "person").alias("p"), display.wrap_text(F.lit("cogito"), "language", "la").alias("l"),
        display.authority_links(viaf=F.lit("12"), estc=F.lit("")).alias("a"), display.coverage_line(F.lit(973), F.lit(1000)).alias("c"), display.coverage_line(F.lit(0), F.lit(0)).alias("z"),
    ).first()
    assert row.m == r"[w:to~morrow=a\=b\]]" and row.p == "[p:Will]" and row.l == "$la:cogito$"
    assert [(x.kind, x.label, x.url) for x in row.a] == [("viaf", "VIAF", "https://viaf.org/viaf/12")] and row.c == "97.3% of 1000 tokens accounted" and row.z == "no tokens"
