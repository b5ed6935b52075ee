from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import catalogue, rules
from lexloom.sources import files, marked

EDITION = """# Hume.EHU.1748

[metadata]
title = "Enquiry"
breadcrumb = "EHU"
imported = false
published = [1748]
authors = ["hume"]

[metadata.dictionary]
lay = "lie"

{#1, pages="1-2"}
The first line of it.

## one

[metadata]
title = "One"
breadcrumb = "One"

{#2, speaker="Philo"}
Then [w:lay=lie] he spoke.

### deep

[metadata]
title = "Deep"
breadcrumb = "Deep"
published = [1750]

{#3}
More.

## <Smith.TMS.1759>
"""
FILES = {
    "authors/hume.mit": '# hume\n\n[metadata]\nforename = "David"\nsurname = "Hume"\nbirth = 1711\ndeath = 1776\nnationality = "Scottish"\nsex = "Male"\nviaf = "17"\n',
    "authors/Bad.mit": '# wrong\n\n[metadata]\nforename = "X"\nbirth = "long ago"\nsex = "None"\nnick = "y"\nviaf = "0"\n',
    "works/hume/ehu/index.mit": '# Hume.EHU\n\n[metadata]\ntitle = "Enquiry"\nbreadcrumb = "EHU"\nauthors = ["hume"]\ncanonical = "1748"\n',
    "works/hume/ehu/1748.mit": EDITION,
    "works/hume/ehu/1750.mit": '# Hume.EHU.1751\n\n[metadata]\ntitle = "E"\nbreadcrumb = "E"\nauthors = ["nobody"]\ncanonical = "x"\n\n{#1, colour="red"}\nText.\n\n## a.b\n\n[metadata]\ntitle = "T"\nbreadcrumb = "B"\n',
    "works/hume/thn/index.mit": '# Hume.THN\n\n[metadata]\ntitle = "T"\nbreadcrumb = "T"\nauthors = ["hume"]\ncanonical = "1739"\n',
    "works/hume-smith/x/1.mit": "no heading\n",
}


def collection(spark):
    parsed = marked.parse_files(spark.createDataFrame(list(FILES.items()), "path string, text string")).cache()
    return rules.Collection(parsed, marked.sections_of(parsed), marked.blocks_of(parsed))


def texts(raw):
    return [t["text"] + (f"/{t['exemption']}" if t["exemption"] else "") + (f"={t['word']}" if t["word"] else "") for t in marked.tokens(raw)]


def test_inline_markup():
    assert texts("Yet [p:Old *Moll* Green] sang _low_ in [\"Songs of Ice\"] by $fr:la mer$ at [l:Hull], stanza XLIV.") == [
        "Yet", "Old/person", "Moll/person", "Green/person", "sang", "low", "in", "Songs/citation", "of/citation", "Ice/citation", "by", "la/language", "mer/language", "at", "Hull/place", "stanza", "XLIV",
    ]
    assert texts("ad~hoc rules, [w:whan=when] or [w:on~to=onto].") == ["ad hoc", "rules", "whan=when", "or", "on to=onto"]


def test_both_versions_are_united():
    assert texts("seven [-shippes-][+ships+] sailed [-forthe-] at dawn.") == ["seven", "ships", "sailed", "at", "dawn", "shippes", "forthe"]


def test_quotes_lists_and_tables():
    assert texts("> As she said") == ["As", "she", "said"] and texts("- red\n- pale green") == ["red", "pale", "green"] and texts("| tin | ten pence |\n| lead |") == ["tin", "ten", "pence", "lead"]


def test_sections_and_blocks(spark):
    c = collection(spark)
    rows = {r.id: r for r in c.sections.filter("path = 'works/hume/ehu/1748.mit'").collect()}
    assert list(rows["Hume.EHU.1748.one.deep"].ancestors) == ["Hume.EHU.1748", "Hume.EHU.1748.one"]
    assert rows["Hume.EHU.1748.<Smith.TMS.1759>"].ref == "Smith.TMS.1759"
    assert rows["Hume.EHU.1748"].dictionary == {"lay": "lie"}
    blocks = c.blocks.filter("path = 'works/hume/ehu/1748.mit'").orderBy("start_line").collect()
    assert [b.block_id for b in blocks] == ["1", "2", "3"] and blocks[1].metadata == {"speaker": '"Philo"'}
    rows = marked.tokens_of(c.blocks).filter("word is not null").collect()
    assert [(r.text, r.word, r.section_id) for r in rows] == [("lay", "lie", "Hume.EHU.1748.one")]


def test_inheritance_within_a_file(spark):
    c = collection(spark)
    rows = {r.id: r for r in catalogue.inherited(c.sections.filter("ref is null and path = 'works/hume/ehu/1748.mit'"), ["published", "imported", "title"]).collect()}
    assert rows["Hume.EHU.1748.one"].published == "[1748]" and rows["Hume.EHU.1748.one.deep"].published == "[1750]" and rows["Hume.EHU.1748.one.deep"].imported == "false"
    merged = catalogue.merged_dictionary(c.sections.filter("ref is null")).collect()
    assert {(r.id.split(".")[-1], r.surface, r.value) for r in merged} == {("1748", "lay", "lie"), ("one", "lay", "lie"), ("deep", "lay", "lie")}


def test_rules_find_each_fault_and_nothing_else(spark):
    found = [(r.rule, r.path, r.message) for r in rules.validate(collection(spark)).collect()]
    by = {}
    for name, path, message in found:
        by.setdefault(path, set()).add(message)
    assert by["works/hume-smith/x/1.mit"] == {"text before the document heading", "no document heading"}
    assert {'missing "surname"', '"birth" should be number', '"sex" must be "Male" or "Female"', 'unknown key "nick"', '"viaf" should be a VIAF cluster ID (digits)', "author files are <slug>.mit"} <= by["authors/Bad.mit"]
    assert by["works/hume/thn/index.mit"] == {'canonical "1739" has no edition in works/hume/thn'}
    wrong = by["works/hume/ehu/1750.mit"]
    assert {'root ID is "Hume.EHU.1751", expected "hume.ehu.1750"', 'unknown author "nobody"', 'unknown key "colour"', 'heading "a.b" should be a bare segment (no dots)', '"canonical" belongs only on a work\'s index.mit stub', 'missing "imported" (not inherited either)', 'missing "published" (not inherited either)'} <= wrong
    assert by["works/hume/ehu/1748.mit"] == {'unresolvable borrowed child "Smith.TMS.1759"'}
    assert by["works/hume-smith"] == {'joint host names unknown author "smith"'} and by["works/hume-smith/x"] == {"directory has no index.mit"}
    assert "authors/hume.mit" not in by and "works/hume/ehu/index.mit" not in by


def test_rules_by_name_make_the_whole(spark):
    c = collection(spark)
    whole = {tuple(r) for r in rules.validate(c).collect()}
    parts = {tuple(r)[1:] for name in rules.RULES for r in rules.validate(c, [name]).collect()}
    assert {r[1:] for r in whole} == parts


def test_register_rules(spark):
    c = collection(spark)
    values = [("l.json", 108, 0, "lay", '[null, "=lie"]'), ("l.json", 108, 1, "lie", "null"), ("t.json", 116, 0, "then", '"thann"')]
    c.entries = spark.createDataFrame(values, "shard string, shard_ord int, key_ord int, surface string, value string")
    c.marked = spark.createDataFrame([("p", "s", 3, "lay", "lie"), ("p", "s", 4, "lay", "zzz")], "path string, section_id string, line int, surface string, value string")
    found = [(r.rule, r.message) for r in rules.validate(c, ["dictionary readings resolve within the register", "word markup selects a dictionary reading", "dictionary overrides select a reading"]).collect()]
    assert found == [("dictionary readings resolve within the register", '"thann" has no entry'), ("word markup selects a dictionary reading", '"zzz" selects no reading of "lay"')]


def test_reading_a_tree(spark, tmp_path):
    for path, text in FILES.items():
        (tmp_path / "data" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / path).write_text(text)
    rows = files.source_files(spark, str(tmp_path))
    assert {(r.path, r.text) for r in rows.collect()} == set(FILES.items())
    assert files.source_listing(spark, str(tmp_path)).count() == len(FILES)
    kinds = {r.path: r.kind for r in files.layout(rows).collect()}
    assert kinds["authors/hume.mit"] == "author" and kinds["works/hume/ehu/index.mit"] == "stub" and kinds["works/hume/ehu/1748.mit"] == "edition"
    assert files.shard_entries(spark, str(tmp_path)).count() == 0
    (tmp_path / "data/dictionary").mkdir()
    (tmp_path / "data/dictionary/i.json").write_text('{\n  "I": null,\n  "is": "=be"\n}\n')
    assert [(r.surface, r.value) for r in files.shard_entries(spark, str(tmp_path)).orderBy("key_ord").collect()] == [("I", "null"), ("is", '"=be"')]
    (tmp_path / "words.txt").write_text(" The\n\nand\nthe\n")
    (tmp_path / "exceptions.json").write_text('["musick"]')
    assert {r.word for r in files.word_list(spark, str(tmp_path / "words.txt")).collect()} == {"the", "and"}
    assert [r.word for r in files.exception_list(spark, str(tmp_path / "exceptions.json")).collect()] == ["musick"]


def test_tables_round_trip_and_partial_writes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "host_slug string, n int")
    files.write_tables({"editions": df}, str(tmp_path), {"editions": "host_slug"})
    files.write_changed(spark.createDataFrame([("b", 3)], "host_slug string, n int"), f"{tmp_path}/editions", "host_slug")
    found = files.read_tables(spark, str(tmp_path), ["editions"])["editions"]
    assert sorted((r.host_slug, r.n) for r in found.collect()) == [("a", 1), ("b", 3)]


def test_resolving_paths_puts_case_aside(spark):
    held = spark.createDataFrame([("works/hume/ehu/1748.mit",), ("works/smith/tms/1759/index.mit",)], "path string")
    refs = spark.createDataFrame([("Hume.EHU.1748",), ("Smith.TMS.1759",), ("Hume.EHU",), ("A.B.1",)], "ref string")
    assert {r.ref: r.resolved for r in files.resolve_paths(refs, held).collect()} == {"Hume.EHU.1748": "works/hume/ehu/1748.mit", "Smith.TMS.1759": "works/smith/tms/1759/index.mit", "Hume.EHU": None, "A.B.1": None}


def test_catalogue(spark):
    works = spark.createDataFrame([("w1", ["a", "b"], "1740"), ("w2", ["a"], "1999"), ("w3", ["c"], None)], "work_key string, author_slugs array<string>, canonical_slug string")
    editions = spark.createDataFrame([("w1", "1740", [1740]), ("w1", "1750", [1750, 1739]), ("w2", "1760", []), ("w2", "1761", None)], "work_key string, slug string, published array<int>")
    links, authors = catalogue.register_authors(works, spark.createDataFrame([("a", "Zed"), ("b", "Éa")], "slug string, surname string"))
    assert {(r.slug, r.surname, r.synthesised) for r in authors.collect()} == {("a", "Zed", False), ("b", "Éa", False), ("c", "c", True)}
    chosen = {r.work_key: (r.canonical, r.fell_back) for r in catalogue.canonical_edition(works, editions).collect()}
    assert chosen == {"w1": ("1740", False), "w2": ("1761", True), "w3": (None, False)}
    years = catalogue.first_published(works, editions)
    assert {r.work_key: r.first_published for r in years.collect()} == {"w1": 1739, "w2": None, "w3": None}
    own = catalogue.author_first_published(links, years)
    assert [r.slug for r in catalogue.author_order(authors.join(own, "slug", "left")).collect()] == ["b", "a", "c"]
    assert [(r.slug, r.next_slug) for r in catalogue.next_edition(editions).filter("work_key = 'w1'").orderBy("slug").collect()] == [("1740", "1750"), ("1750", None)]
    assert {r.work_key for r in catalogue.comparable_works(editions).collect()} == {"w1", "w2"}
    joint = spark.createDataFrame([("a-b", None), ("a", ["b", "a"]), ("a-b", ["b", "c"])], "h string, d array<string>")
    assert [r[0] for r in joint.select(catalogue.joint_authors(F.col("h"), F.col("d"))).collect()] == [["a", "b"], ["a", "b"], ["b", "c"]]


def test_composition_cuts_cycles(spark):
    refs = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("p", "z"), ("p", None)], "host_key string, doc_key string")
    held, cycles = catalogue.compose(refs)
    assert {(r.root, r.doc_key) for r in held.collect()} == {("x", "y"), ("x", "z"), ("y", "z"), ("y", "x"), ("z", "x"), ("z", "y"), ("p", "z"), ("p", "x"), ("p", "y")}
    assert {(r.host_key, r.doc_key) for r in cycles.collect()} == {("x", "y"), ("y", "z"), ("z", "x")}


def test_composition_of_a_deep_chain_and_of_itself(spark):
    refs = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(50, 50)], "host_key long, doc_key long")
    held, cycles = catalogue.compose(refs)
    assert {(r.root, r.doc_key): r.depth for r in held.collect()} == {(i, j): j - i + 1 for i in range(13) for j in range(i + 1, 13)}
    assert [(r.host_key, r.doc_key) for r in cycles.collect()] == [(50, 50)]
