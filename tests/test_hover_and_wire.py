from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import hover, register, scan
from lexloom.sources import marked, wire
from lexloom.streaming import incremental
from tests.test_register import entries
from tests.test_sources import FILES


def test_hover(spark):
    values = {"bishop": None, "lay": [None, "=lie"], "lie": None}
    expanded = register.expand(register.readings(entries(spark, values)))
    shown = spark.createDataFrame([("Lay",), ("bishop's",), ("1739",), ("zzz",)], "display string")
    overrides = spark.createDataFrame([("lay", "lie")], "surface string, value string")
    rows = {r.display: r for r in hover.hover(shown, expanded, overrides).collect()}
    lay = rows["Lay"]
    assert (lay.status, lay.lemma, lay.form, lay.ambiguous, lay.overridden, lay.clitic) == ("registered", "lie", "lay", True, True, None)
    assert [(o.lemma, o.spelling, o.value) for o in lay.others] == [("lay", "lay", None)]
    assert (rows["bishop's"].status, rows["bishop's"].form, rows["bishop's"].clitic) == ("possessive", "bishop", "'s")
    assert rows["1739"].status == "mechanical" and rows["zzz"].status == "unaccounted"


def test_typed_entries(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(hover.lemma_entry(F.lit(" Virtue "))).surface == "virtue"
    assert one(hover.lemma_entry(F.lit("two words"))).error == "Enter a single word for the lemma."
    assert one(hover.form_entry(F.lit("go"), F.lit("went"))).value == "=go"
    assert one(hover.form_entry(F.lit("go"), F.lit("GO"))).error == "A form must differ from its lemma."
    assert one(hover.variant_entry(F.lit("'tis"), F.lit("it  is"))).value == "it is"
    assert one(hover.variant_entry(F.lit("a"), F.lit("a"))).error == "A variant must point at a different spelling."


def test_targets_and_cascade(spark):
    words = lambda *x, name="surface": spark.createDataFrame([(w,) for w in x], f"{name} string")
    found = {r.target: r.state for r in hover.targets(words("a", "b", "c", name="target"), words("a"), words("b"), "spelling").collect()}
    assert found == {"a": "resolved", "b": "prompt", "c": "reject"}
    schema = "surface string, spellings array<string>, lemma string"
    offered = spark.createDataFrame([("y", ["z"], None), ("z", None, "z"), ("q", None, "q")], schema)
    wanted = spark.createDataFrame([("x", ["y", "known"], None)], schema)
    assert {(r.surface, r.round) for r in hover.cascade(wanted, words("known"), offered).collect()} == {("x", 0), ("y", 1), ("z", 2)}


def test_occurrences_with_units(spark):
    blocks = spark.createDataFrame([("p", "s", 0, "it is a priori zzz [p:Zed] to morrow", 1)], "path string, section_id string, block_ordinal int, raw string, start_line int")
    tokens = marked.tokens_of(blocks)
    held = spark.createDataFrame([(w,) for w in ("it", "is", "a priori", "to morrow")], "surface string")
    rows = [(r.surface, r.fuse) for r in scan.occurrences(tokens, held).orderBy("pos").collect()]
    assert rows == [("a", "a priori"), ("priori", "a priori"), ("zzz", None), ("to", "to morrow"), ("morrow", "to morrow")]


def test_records_round_trip_and_stamp(spark, tmp_path):
    parsed = marked.parse_files(spark.createDataFrame(list(FILES.items()), "path string, text string"))
    tokens = marked.tokens_of(marked.blocks_of(parsed))
    bad = spark.createDataFrame([("works/hume/ehu/1748.mit", "r", "m", 3)], "path string, rule string, message string, line int")
    wire.source_records(parsed, tokens, bad, "/here").write.parquet(f"{tmp_path}/records")
    rows = {r.path: r for r in wire.read_records(spark, f"{tmp_path}/records", "/here").collect()}
    assert rows["works/hume/ehu/1748.mit"].size == len(FILES["works/hume/ehu/1748.mit"])
    assert [s.surface for s in rows["works/hume/ehu/1748.mit"].surfaces][:2] == ["first", "he"]
    assert wire.read_records(spark, f"{tmp_path}/records", "/elsewhere") is None


def test_documents_keep_references_that_resolve(spark):
    parsed = marked.parse_files(spark.createDataFrame([("p", "# A.B.1\n\n{#1}\nx\n\n## one\n\n## <C.D.2>\n\n## <E.F.3>\n")], "path string, text string"))
    keys = spark.createDataFrame([("c.d.2", "c/d/2")], "doc_id string, doc_key string")
    nodes = json.loads(wire.documents_json(marked.sections_of(parsed), keys).first().json)
    assert [n.get("id") for n in nodes[:2]] == ["A.B.1", "A.B.1.one"] and nodes[2:] == [{"__ref": "c/d/2"}]
    assert nodes[0]["blocks"][0]["raw"] == "x" and "parent" not in nodes[0]


def test_catalogue_needs_its_documents(spark):
    editions, docs = spark.createDataFrame([("a",), ("b",)], "doc_key string"), spark.createDataFrame([("a", "{}")], "doc_key string, json string")
    with pytest.raises(FileNotFoundError, match="b"):
        wire.load_catalogue({"editions": editions, "documents": docs})
    assert wire.load_catalogue({"editions": editions.filter("doc_key = 'a'"), "documents": docs}).count() == 1


def test_import_report(spark):
    text = "# A.B.1\n\n{#1}\n<<x>>a<</x>> //3// /// ▪\n\n## one\n\n{#2}\nb\n"
    parsed = marked.parse_files(spark.createDataFrame([("p", text)], "path string, text string"))
    r = wire.import_report(parsed, marked.sections_of(parsed), parsed).first()
    assert (r.sections, r.blocks, r.escapes, r.page_markers, r.unread_glyphs, r.diagnostics) == (1, 2, 1, 2, 1, 0)


def test_write_queue(spark):
    rows = [(1, "source", "a"), (2, "full", None), (3, "source", "a"), (4, "source", "b"), (5, "dictionary", None), (6, "remove", "a")]
    found = {(r.target, r.kind) for r in incremental.pending_writes(spark.createDataFrame(rows, "seq int, kind string, path string")).collect()}
    assert found == {("*", "full"), ("a", "remove"), ("b", "source"), ("dictionary", "dictionary")}


def test_submission_states(spark):
    rows = [(False, True, 0, None), (True, False, 0, None), (True, False, 2, None), (True, True, 0, None), (True, True, 1, "open"), (True, True, 0, "closed")]
    df = spark.createDataFrame(rows, "s boolean, b boolean, n int, p string")
    assert [r[0] for r in df.select(incremental.submission_state(F.col("s"), F.col("b"), F.col("n"), F.col("p"))).collect()] == ["signedOut", "clean", "editing", "unfinished", "sent", "decided"]
