from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import accounting, register
from lexloom.sources import files

ENTRY = "shard string, shard_ord int, key_ord int, surface string, value string"


def entries(spark, values: dict):
    rows = [(f"{k[0]}.json", ord(k[0]), i, k, json.dumps(v, ensure_ascii=False)) for i, (k, v) in enumerate(values.items())]
    return spark.createDataFrame(rows, ENTRY)


def expanded(spark, values: dict):
    rows = register.expand(register.readings(entries(spark, values))).orderBy("surface", "reading_ord").collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r.surface, []).append([(w.spelling, w.lemma) for w in r.words])
    return out


def test_identities_and_references(spark):
    found = expanded(spark, {"'tis": "it is", "is": "=be", "it": None, "vertues": "virtues", "virtues": "=virtue", "virtue": None})
    assert found["'tis"] == [[("it", "it"), ("is", "be")]]
    assert found["vertues"] == [[("virtues", "virtue")]] and found["virtues"] == [[("virtues", "virtue")]]


def test_ambiguity_is_inherited_in_order(spark):
    found = expanded(spark, {"laie": "lay", "lay": [None, "=lie"], "lie": None})
    assert found["laie"] == [[("lay", "lay")], [("lay", "lie")]]


def test_ordered_product(spark):
    found = expanded(spark, {"x": "a b", "a": [None, "=q"], "b": None, "q": None})
    assert found["x"] == [[("a", "a"), ("b", "b")], [("a", "q"), ("b", "b")]]


def test_words_of_several_parts(spark):
    found = expanded(spark, {"a priori": None, "to day": "=today"})
    assert found["a priori"] == [[("a", "a"), ("priori", "priori")]] and found["to day"] == [[("to day", "today")]]


def test_dangling_reference_is_its_own_lemma(spark):
    assert expanded(spark, {"vertue": "virtue"})["vertue"] == [[("virtue", "virtue")]]


@pytest.mark.parametrize(
    ("value", "said"),
    [([None], "ambiguous"), (3, "null or a string"), ("", "empty"), ("a  b", "single spaces"), ("a=b c", "spellings only"), ("a-b", "not a word"), ("=1", "not a word"), ("s", "null"), ([None, 3], "null or a string")],
)
def test_malformed_entries(spark, value, said):
    assert said in register.parse_entries(entries(spark, {"s": value})).first().error


def test_violations(spark):
    closed = {"virtue": None, "vertue": "virtue"}
    assert register.violations(register.readings(entries(spark, closed))).count() == 0
    bad = {"a": "gone", "b": "a", "c": "=nolemma", "d": "=b", "e": [None, "=e"], "f": [None, "virtue", "virtue"], "virtue": None}
    said = {(r.surface, r.message) for r in register.violations(register.readings(entries(spark, bad))).collect()}
    assert ("a", '"gone" has no entry') in said
    assert ("b", 'the entry for "a" has no identity reading (nothing to derive a lemma from)') in said
    assert ("c", '"nolemma" has no entry') in said
    assert ("d", '"b" is not a citation form (its entry has no null reading)') in said
    assert ("f", 'duplicate reading "virtue"') in said


def test_canonical_spelling(spark):
    rows = register.readings(entries(spark, {"virtue": None, "vertue": "virtue", "vertu": "virtue", "musick": None, "music": "musick"}))
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "word string")
    found = {r.canonical: r.expected for r in register.canonical_spelling(rows, words("virtue", "music"), words("zzz")).collect()}
    assert found == {"musick": "music"}
    pinned = {r.canonical: (r.expected, r.is_pinned) for r in register.canonical_spelling(rows, words("virtue", "music"), words("musick", "vertue")).collect()}
    assert pinned == {"virtue": ("vertue", True)}


def test_selection(spark):
    values = {"lay": [None, "=lie"], "lie": None, "the": None}
    of = register.by_surface(register.expand(register.readings(entries(spark, values))))
    asked = spark.createDataFrame([("lay", "lie"), ("lay", "lay"), ("lay", "x"), ("the", "the"), ("no", "no")], "surface string, value string").join(of, "surface", "left")
    said = {(r.surface, r.value): r.m for r in asked.select("*", register.selection_violation(F.col("surface"), F.col("of"), F.col("value")).alias("m")).collect()}
    assert said[("lay", "lie")] is None
    assert said[("lay", "lay")] == '"lay" selects more than one reading of "lay"'
    assert said[("lay", "x")] == '"x" selects no reading of "lay"'
    assert "unambiguous" in said[("the", "the")] and said[("no", "no")] == 'no dictionary entry for "no"'


def test_resolution_order(spark):
    ex = register.expand(register.readings(entries(spark, {"lay": [None, "=lie", "ley"], "lie": None, "ley": None})))
    asked = spark.createDataFrame([("lay", "lie", "ley"), ("lay", None, "ley"), ("lay", "zzz", "qqq"), ("no", None, None)], "surface string, marked string, override string")
    assert [r.reading and r.reading.lemma for r in register.resolve(asked, ex).orderBy(F.col("surface").desc(), "marked").collect()] == [None, "ley", "lie", "lay"]


def test_shards_round_trip(spark):
    values = {"if": None, "I": None, "increases": "=increase", "increase": None, "then": [None, "than"], "than": None}
    rows = register.readings(entries(spark, values))
    texts = {r.shard: r.text for r in register.render_shards(register.entry_json(rows)).collect()}
    assert texts["i.json"] == '{\n  "I": null,\n  "if": null,\n  "increase": null,\n  "increases": "=increase"\n}\n'
    assert json.loads(texts["t.json"]) == {"than": None, "then": [None, "than"]}
    again = files.parse_shards(spark.createDataFrame(list(texts.items()), "shard string, text string"))
    key = lambda df: sorted((r.surface, r.reading_ord, r.lemma, r.spellings) for r in df.collect())
    assert json.dumps(key(register.readings(again))) == json.dumps(key(rows))
    assert register.structure_problems(again).count() == 0


def test_structure_problems(spark):
    rows = [("a.json", 97, 0, "b", "null"), ("a.json", 97, 1, "a", "null"), ("b.json", 98, 0, "a", "null"), ("b.json", 98, 1, "B", "null"), ("b.json", 98, 2, "b1", "null"), ("b.json", 98, 3, "bx", "3")]
    said = [r.message for r in register.structure_problems(spark.createDataFrame(rows, ENTRY)).collect()]
    assert any("not sorted" in m for m in said) and any(m == 'duplicate of "a" in a.json' for m in said)
    assert "the key is not folded (lower-cased)" in said and "the key is not a word" in said and "a reading is null or a string" in said and "belongs in b.json" in said


def test_views(spark):
    values = {"laid": "=lay", "lay": [None, "=lie"], "laie": "lay", "lie": None}
    rows = register.readings(entries(spark, values))
    found = {r.lemma: (r.forms, r.headword) for r in register.paradigms(register.expand(rows)).collect()}
    assert found["lay"] == (["laid", "lay"], True) and found["lie"] == (["lay", "lie"], True)
    assert [(r.surface, r.target, r.ambiguous) for r in register.variants(rows).collect()] == [("laie", "lay", False)]


def test_edits(spark):
    values = spark.createDataFrame([("a", "null"), ("b", "null")], "surface string, value string")
    changed, removed = spark.createDataFrame([("b", '"a"'), ("c", "null")], "surface string, value string"), spark.createDataFrame([("a",)], "surface string")
    assert sorted(map(tuple, register.edit_entries(values, changed, removed).collect())) == [("b", '"a"'), ("c", "null")]


def test_accounting(spark):
    docs = spark.createDataFrame([(1, "'Tis writing then vertue MDCCXL 1739 zzz"), (2, "vertue's own kin, not zzz's"), (3, None)], "doc_id long, text string")
    entries_ = spark.createDataFrame([(s,) for s in ("'tis", "then", "vertue")], "surface string")
    rows = accounting.with_status(accounting.surface_counts(docs, "doc_id"), entries_)
    found = {(r.doc_id, r.surface): r.status for r in rows.collect()}
    assert found[(1, "'tis")] == "registered" and found[(1, "mdccxl")] == "mechanical" and found[(1, "zzz")] == "unaccounted" and found[(2, "vertue's")] == "possessive"
    total = {r.doc_id: (r.total, r.accounted) for r in accounting.coverage(rows, "doc_id").collect()}
    assert total == {1: (7, 5), 2: (5, 1), None: (12, 6)}


def test_accounting_plan_joins_vocabulary_by_hash(spark, capsys):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    accounting.with_status(accounting.surface_counts(docs), accounting.register_of(docs)).explain()
    assert "NestedLoop" not in capsys.readouterr().out
