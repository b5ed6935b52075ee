from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.operators import mining, search
from lexloom.operators.search import Query


def counts(spark, text, query):
    return spark.createDataFrame([(text,)], "t string").select(search.count_matches(F.col("t"), query)).first()[0]


def test_matching(spark):
    assert counts(spark, "vertue vertues Vertue", Query("vertue")) == 3
    assert counts(spark, "vertue vertues Vertue", Query("vertue", whole_word=True)) == 2
    assert counts(spark, "vertue vertues Vertue", Query("vertue", case_sensitive=True)) == 2
    assert counts(spark, "café cafe", Query("cafe", whole_word=True)) == 1
    assert counts(spark, "a.b axb", Query("a.b")) == 1 and counts(spark, "a.b axb", Query("a.b", is_regex=True)) == 2
    assert counts(spark, "abc", Query("x*", is_regex=True)) == 0
    with pytest.raises(ValueError):
        search.pattern_of(Query("(", is_regex=True))


def test_scope(spark):
    rows = spark.createDataFrame([("p", ["a"]), ("q", ["a", "b"]), ("r", ["c"])], "path string, author_slugs array<string>")
    paths = lambda q: {r.path for r in search.scoped(rows, q).collect()}
    assert paths(Query("x")) == {"p", "q", "r"} and paths(Query("x", include=(" A ", ""))) == {"p", "q"} and paths(Query("x", include=("a",), exclude=("b",))) == {"p"}


def test_positions_caps_and_replacement(spark):
    lines = spark.createDataFrame([("a", 1, "one two one"), ("a", 2, "one"), ("b", 1, "one one"), ("c", 1, "two")], "path string, line int, text string")
    found = search.positions(lines, Query("one"))
    assert sorted((r.path, r.line, r.start, r.end) for r in found.collect()) == [("a", 1, 1, 4), ("a", 1, 9, 12), ("a", 2, 1, 4), ("b", 1, 1, 4), ("b", 1, 5, 8)]
    kept = search.capped(found.withColumn("ord", F.col("path")), "path", "ord", per_file=2, overall=3).collect()
    assert sorted((r.path, r.line, r.start, r.total) for r in kept) == [("a", 1, 1, 3), ("a", 1, 9, 3), ("b", 1, 1, 2)]
    moved = lines.withColumn("text", F.when((F.col("path") == "a") & (F.col("line") == 2), "gone").otherwise(F.col("text")))
    plan = search.replace_plan(found, moved, Query("one"), "$1 uno")
    assert {(r.path, r.line, r.fresh, r.replacement) for r in plan.collect()} == {("a", 1, True, "$1 uno"), ("a", 2, False, None), ("b", 1, True, "$1 uno")}
    assert spark.range(1).select(search.replaced(F.lit("ab"), Query("(a)(b)", is_regex=True), "$2$1")).first()[0] == "ba"


def test_searchable_lines(spark):
    files = spark.createDataFrame([("p", "# t\n\n{#1}\nbody\n\nmore\n# x")], "path string, text string")
    blocks = spark.createDataFrame([("p", 3, 6)], "path string, start_line int, end_line int")
    assert [(r.line, r.text) for r in search.searchable_lines(files, blocks).orderBy("line").collect()] == [(4, "body"), (6, "more")]


def test_language_lexicon_and_clusters(spark):
    marked = spark.createDataFrame([("la", "quod", 2), ("la", "in", 2), ("la", "vis", 1)], "lang string, word string, n int")
    unmarked = spark.createDataFrame([(None, "in", 5), (None, "other", 1)], "lang string, word string, n int")
    lexicon = mining.language_lexicon(marked.unionByName(unmarked))
    assert {r.word: r.strength for r in lexicon.collect()} == {"quod": "strong", "in": "weak", "vis": "strong"}
    words = "quod in foro vis a in in b quod".split()
    texts = spark.createDataFrame([("d", words), ("e", []), ("f", None)], "key string, words array<string>")
    found = {(r.start, r.end) for r in mining.language_clusters(texts, lexicon, "key").collect()}
    assert found == {(0, 1), (8, 8)}  # foro is unknown; vis is short and alone; weak words alone don't count
    changed = mining.with_overrides(lexicon, spark.createDataFrame([("la", "in", "strong"), ("la", "vis", "ignore")], "lang string, word string, strength string"))
    assert {r.word: r.strength for r in changed.collect()} == {"quod": "strong", "in": "strong"}


def test_longest_phrases(spark):
    texts = spark.createDataFrame([("d", "the great king of france saw great king".split()), ("e", ["saw"]), ("f", []), ("g", None)], "key string, words array<string>")
    phrases = spark.createDataFrame([("great king",), ("king of france",), ("great king of",), ("saw",)], "phrase string")
    found = sorted((r.key, r.start, r.phrase) for r in mining.longest_phrases(texts, phrases, "key", 3).collect())
    assert found == [("d", 1, "great king of"), ("d", 2, "king of france"), ("d", 5, "saw"), ("d", 6, "great king"), ("e", 0, "saw")]


def test_citation_patterns(spark):
    lines = spark.createDataFrame([("d", 1, "as in Sect. IV. of it"), ("d", 2, "See Locke Essay now"), ("d", 3, "[Sect. V.] Lib. 4")], "key string, line int, text string")
    assert sorted((r.line, r.text.strip()) for r in mining.citation_patterns(lines, "key").collect()) == [(1, "Sect. IV."), (2, "See Locke Essay")]
