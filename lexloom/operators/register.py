"""The register: authored entries, their expansion to words with lemmas, and what can be wrong with them.

entries(surface, shard, shard_ord, key_ord, value) hold an entry's JSON text. readings(surface,
reading_ord, lemma, spellings) hold one row per authored reading: a lemma (an identity) or
spellings (a cross-reference). expanded(surface, reading_ord, words) hold words of spelling and lemma.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.words import fold, is_word, letter_of, reading_lemma, reading_spelling, shard_of
from lexloom.session import settled

WORDS = "array<struct<spelling string, lemma string>>"


def _reading_error(item: Column, surface: Column) -> Column:
    """What is wrong with one reading (null is right), or null."""
    lemma = F.substr(item, F.lit(2))
    parts = F.split(item, " ")
    odd = F.filter(parts, lambda s: s.contains("="))
    bad = F.filter(parts, lambda s: ~is_word(s))
    quoted = lambda c, tail: F.concat(F.lit('"'), c, F.lit(tail))
    identity = F.when(~is_word(lemma), quoted(lemma, '" is not a word'))
    reference = (
        F.when(item == surface, "a reading of just the surface itself is written null")
        .when(F.exists(parts, lambda s: s == ""), "words are separated by single spaces")
        .when(F.size(odd) > 0, F.concat(F.lit('a cross-reference lists spellings only — the lemma in "'), F.element_at(odd, 1), F.lit("\" belongs on that spelling's own entry")))
        .when(F.size(bad) > 0, quoted(F.element_at(bad, 1), '" is not a word'))
    )
    return F.when(item.isNull(), None).when(item == "", "an empty reading (write null instead)").when(item.startswith("="), identity).otherwise(reference)


def parse_entries(entries: DataFrame) -> DataFrame:
    """entries with items (array of readings as authored) and error (null where well-formed)."""
    trimmed = F.trim("value")
    is_array, is_text, is_null = trimmed.startswith("["), trimmed.startswith('"'), trimmed == "null"
    many = F.from_json(trimmed, "array<string>")
    one = F.get(F.from_json(F.concat(F.lit("["), trimmed, F.lit("]")), "array<string>"), 0)
    kinds = F.when(is_array, many).when(is_text, F.array(one)).when(is_null, F.array(F.lit(None).cast("string")))
    raw_items = F.when(is_array, F.from_json(trimmed, "array<variant>"))
    not_text = F.exists(raw_items, lambda v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("STRING", "VOID"))
    out = entries.withColumn("items", kinds)
    error = (
        F.when(~(is_array | is_text | is_null) | F.coalesce(not_text, F.lit(False)), "a reading is null or a string")
        .when(is_array & (F.size(F.coalesce("items", F.array().cast("array<string>"))) < 2), "an array value means an ambiguous entry (2+ readings)")
        .otherwise(F.get(F.filter(F.transform("items", lambda i: _reading_error(i, F.col("surface"))), lambda e: e.isNotNull()), 0))
    )
    return out.withColumn("error", error)


def readings(entries: DataFrame) -> DataFrame:
    """One row per reading of well-formed entries: null and =x are identities, the rest spellings."""
    rows = parse_entries(entries).filter("error is null").select("surface", F.posexplode("items").alias("reading_ord", "item"))
    identity = F.col("item").isNull() | F.col("item").startswith("=")
    lemma = F.when(F.col("item").isNull(), F.col("surface")).when(identity, F.substr("item", F.lit(2)))
    return rows.select("surface", "reading_ord", lemma.alias("lemma"), F.when(~identity, F.split("item", " ")).alias("spellings"))


def expand(rows: DataFrame) -> DataFrame:
    """Readings as words with lemmas.

    An identity gives a word for each part where surface and lemma have as many parts, else
    one. A cross-reference takes each spelling's identity lemmas (the spelling itself where it
    has none) and gives their product in order, the first spelling most significant. Spellings
    meet their lemmas in one join; the product is built within a row.
    """
    surface, lemma = F.split("surface", " "), F.split("lemma", " ")
    whole = F.array(F.struct(F.col("surface").alias("spelling"), F.col("lemma").alias("lemma")))
    parts = F.transform(F.arrays_zip(surface.alias("s"), lemma.alias("l")), lambda z: F.struct(z["s"].alias("spelling"), z["l"].alias("lemma")))
    identities = rows.filter("lemma is not null")
    plain = identities.select("surface", "reading_ord", F.lit(0).alias("product_ord"), F.when(F.size(surface) == F.size(lemma), parts).otherwise(whole).cast(WORDS).alias("words"))

    held = identities.groupBy(F.col("surface").alias("spelling")).agg(F.transform(F.sort_array(F.collect_list(F.struct("reading_ord", "lemma"))), lambda x: x["lemma"]).alias("lemmas"))
    named = rows.filter("spellings is not null").select("surface", "reading_ord", F.posexplode("spellings").alias("at", "spelling"))
    met = named.join(held, "spelling", "left").withColumn("lemmas", F.coalesce("lemmas", F.array("spelling")))
    gathered = met.groupBy("surface", "reading_ord").agg(F.sort_array(F.collect_list(F.struct("at", "spelling", "lemmas"))).alias("slots"))
    product = F.aggregate(
        "slots",
        F.array(F.array().cast(WORDS)),
        lambda acc, slot: F.flatten(F.transform(acc, lambda head: F.transform(slot["lemmas"], lambda x: F.concat(head, F.array(F.struct(slot["spelling"].alias("spelling"), x.alias("lemma"))))))),
    )
    crossed = gathered.select("surface", "reading_ord", F.posexplode(product).alias("product_ord", "words"))
    order = F.row_number().over(Window.partitionBy("surface").orderBy("reading_ord", "product_ord")) - 1
    return plain.unionByName(crossed).select("surface", order.alias("reading_ord"), "words", reading_spelling(F.col("words")).alias("spelling"), reading_lemma(F.col("words")).alias("lemma"))


def violations(rows: DataFrame) -> DataFrame:
    """surface and message of readings that don't resolve: dangling spellings, lemmas that are no
    citation form, then duplicates and readings that no selector tells apart (not where spellings dangle)."""
    rows = settled(rows)
    has = rows.groupBy("surface").agg(F.max(F.col("lemma").isNotNull()).alias("identity"), F.max(F.coalesce(F.col("lemma") == F.col("surface"), F.lit(False))).alias("citation"))
    named = rows.filter("spellings is not null").select("surface", F.explode("spellings").alias("name")).distinct()
    of_names = named.join(has.select(F.col("surface").alias("name"), "identity"), "name", "left")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    dangling = of_names.filter("identity is null or not identity").select(
        "surface",
        F.when(F.col("identity").isNull(), F.concat(quote(F.col("name")), F.lit(" has no entry")))
        .otherwise(F.concat(F.lit("the entry for "), quote(F.col("name")), F.lit(" has no identity reading (nothing to derive a lemma from)"))).alias("message"),
    )
    lemmas = rows.filter("lemma is not null and lemma <> surface").select("surface", F.col("lemma").alias("name")).distinct()
    of_lemmas = lemmas.join(has.select(F.col("surface").alias("name"), "citation"), "name", "left").filter("citation is null or not citation")
    uncited = of_lemmas.select(
        "surface",
        F.when(F.col("citation").isNull(), F.concat(quote(F.col("name")), F.lit(" has no entry")))
        .otherwise(F.concat(quote(F.col("name")), F.lit(" is not a citation form (its entry has no null reading)"))).alias("message"),
    )
    whole = settled(expand(rows).join(dangling.select("surface").distinct(), "surface", "left_anti"))
    copies = whole.groupBy("surface", "spelling", "lemma").agg(F.count("*").alias("n"), F.min("reading_ord").alias("first")).filter("n > 1")
    twice = copies.select("surface", F.concat(F.lit("duplicate reading "), quote(F.col("spelling"))).alias("message"))
    once = whole.select("surface", "reading_ord", "spelling", "lemma").join(copies.select("surface").distinct(), "surface", "left_anti")
    names_of = once.select("surface", "reading_ord", F.explode(F.array_distinct(F.array("spelling", "lemma"))).alias("value"))
    unique = names_of.groupBy("surface", "value").agg(F.count("*").alias("n"), F.min("reading_ord").alias("reading_ord")).filter("n = 1").select("surface", "reading_ord").distinct()
    lost = once.filter("reading_ord > 0").join(unique, ["surface", "reading_ord"], "left_anti").select("surface", F.concat(F.lit("no selector is unique to the reading "), quote(F.col("spelling"))).alias("message"))
    return dangling.unionByName(uncited).unionByName(twice).unionByName(lost).distinct()


def canonical_spelling(rows: DataFrame, listed: DataFrame, pinned: DataFrame, shown: Callable[[Column], Column] = lambda surface: surface) -> DataFrame:
    """Classes whose canonical spelling isn't the expected one: a canonical entry and the surfaces
    whose only reading is a one-word reference to it; expected is the least pinned, else the least listed member.
    Classes and lists meet by surfaces as shown; entries of one shown surface are read each by itself."""
    only = rows.groupBy("surface").agg(F.count("*").alias("n"), F.first("spellings").alias("spellings")).filter("n = 1 and size(spellings) = 1").select("surface", F.col("spellings")[0].alias("canonical"))
    heads = rows.select(F.col("surface").alias("canonical")).distinct()
    members = only.join(heads, "canonical", "left_semi")
    members = members.unionByName(members.select("canonical").distinct().select(F.col("canonical").alias("surface"), "canonical"))
    members = members.select(shown(F.col("surface")).alias("surface"), shown(F.col("canonical")).alias("canonical"))
    seen = members.join(listed.select(F.col("word").alias("surface"), F.lit(True).alias("listed")).distinct(), "surface", "left").join(
        pinned.select(F.col("word").alias("surface"), F.lit(True).alias("pinned")).distinct(), "surface", "left"
    )
    best = seen.groupBy("canonical").agg(F.min(F.when(F.col("pinned"), F.col("surface"))).alias("pin"), F.min(F.when(F.col("listed"), F.col("surface"))).alias("word"))
    return best.withColumn("expected", F.coalesce("pin", "word")).filter("expected is null or expected <> canonical").select("canonical", "expected", F.col("pin").isNotNull().alias("is_pinned"))


def select_reading(of: Column, value: Column) -> Column:
    """The one reading whose spelling or lemma is the value, null if none or several; of is array<struct<spelling, lemma>>."""
    hits = F.filter(of, lambda r: (r["spelling"] == value) | (r["lemma"] == value))
    return F.when(F.size(hits) == 1, hits[0])


def selection_violation(surface: Column, of: Column, value: Column, usage: str = "overrides are") -> Column:
    """Why a value selects no reading of a surface, or null; of is null where the surface has no entry."""
    hits = F.size(F.filter(of, lambda r: (r["spelling"] == value) | (r["lemma"] == value)))
    said = lambda a, x, b, y=None, c="": F.concat(*[p for p in (F.lit(a), x, F.lit(b), y, F.lit(c)) if p is not None])
    return (
        F.when(of.isNull(), said('no dictionary entry for "', surface, '"'))
        .when(F.size(of) < 2, said('"', surface, f'" is unambiguous — {usage} only for ambiguous surfaces'))
        .when(hits == 0, said('"', value, '" selects no reading of "', surface, '"'))
        .when(hits > 1, said('"', value, '" selects more than one reading of "', surface, '"'))
    )


def override_violation(surface: Column, of: Column, value: Column) -> Column:
    quoted = F.concat(F.lit('"'), surface, F.lit('"'))
    return F.when(~is_word(surface), F.concat(quoted, F.lit(" is not a word"))).when(surface != fold(surface), F.concat(quoted, F.lit(" is not folded (lower-cased)"))).otherwise(selection_violation(surface, of, value))


def by_surface(expanded: DataFrame) -> DataFrame:
    """One row per surface with its readings in order."""
    rows = F.sort_array(F.collect_list(F.struct("reading_ord", "spelling", "lemma")))
    return expanded.groupBy("surface").agg(F.transform(rows, lambda r: F.struct(r["spelling"].alias("spelling"), r["lemma"].alias("lemma"))).alias("of"))


def resolve(marked: DataFrame, expanded: DataFrame) -> DataFrame:
    """marked (surface, marked, override) with the reading that counts: mark-up, then override, then the default."""
    of = by_surface(expanded)
    out = marked.join(of, "surface", "left")
    return out.withColumn("reading", F.coalesce(select_reading(F.col("of"), F.col("marked")), select_reading(F.col("of"), F.col("override")), F.get("of", F.lit(0)))).drop("of")


def variants(rows: DataFrame) -> DataFrame:
    """Surfaces with a cross-reference: the first one, and whether there are more readings."""
    n = rows.groupBy("surface").agg(F.count("*").alias("n"), F.min(F.when(F.col("spellings").isNotNull(), F.struct("reading_ord", F.array_join("spellings", " ").alias("target")))).alias("first"))
    return n.filter("first is not null").select("surface", F.col("first.target").alias("target"), (F.col("n") > 1).alias("ambiguous"))


def paradigms(expanded: DataFrame) -> DataFrame:
    """Lemmas with their distinct spellings in order and whether the lemma is a headword of the register."""
    words = expanded.select("surface", F.explode("words").alias("w")).select("surface", F.col("w.lemma").alias("lemma"), F.col("w.spelling").alias("spelling"))
    forms = words.groupBy("lemma").agg(F.array_sort(F.collect_set("spelling")).alias("forms"))
    return forms.join(expanded.select(F.col("surface").alias("lemma"), F.lit(True).alias("headword")).distinct(), "lemma", "left").withColumn("headword", F.coalesce("headword", F.lit(False)))


def structure_problems(entries: DataFrame) -> DataFrame:
    """Problems of shards: keys that are unsorted (once a shard), not words, not folded, duplicates, malformed or misplaced."""
    in_shard = Window.partitionBy("shard").orderBy("key_ord")
    across = Window.partitionBy("surface").orderBy("shard_ord", "key_ord")
    rows = parse_entries(entries).withColumns({"previous": F.lag("surface").over(in_shard), "copy": F.row_number().over(across), "owner": F.first("shard").over(across)})
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    unsorted = rows.filter("surface < previous").groupBy("shard").agg(F.min(F.struct("key_ord", "surface", "previous")).alias("x"))
    first = unsorted.select("shard", F.lit(None).cast("string").alias("surface"), F.concat(F.lit("keys are not sorted ("), quote(F.col("x.surface")), F.lit(" after "), quote(F.col("x.previous")), F.lit(")")).alias("message"), F.lit(False).alias("dropped"))
    surface = F.col("surface")
    fatal = (
        F.when(~is_word(surface), "the key is not a word")
        .when(surface != fold(surface), "the key is not folded (lower-cased)")
        .when(F.col("copy") > 1, F.concat(F.lit("duplicate of "), quote(surface), F.lit(" in "), F.col("owner")))
        .otherwise(F.col("error"))
    )
    lost = rows.withColumn("message", fatal).filter("message is not null").select("shard", "surface", "message", F.lit(True).alias("dropped"))
    moved = rows.filter(fatal.isNull() & (F.col("shard") != shard_of(surface))).select("shard", "surface", F.concat(F.lit("belongs in "), shard_of(surface)).alias("message"), F.lit(False).alias("dropped"))
    return first.unionByName(lost).unionByName(moved)


def entry_json(rows: DataFrame) -> DataFrame:
    """surface and value, the entry's canonical JSON: null, a string, or an array of those."""
    item = F.when(F.col("lemma") == F.col("surface"), F.lit(None)).when(F.col("lemma").isNotNull(), F.concat(F.lit("="), F.col("lemma"))).otherwise(F.array_join("spellings", " "))
    text = F.when(item.isNull(), "null").otherwise(F.concat(F.lit('"'), F.regexp_replace(item, r'(["\\])', r"\\$1"), F.lit('"')))
    gathered = rows.select("surface", "reading_ord", text.alias("t")).groupBy("surface").agg(F.transform(F.sort_array(F.collect_list(F.struct("reading_ord", "t"))), lambda x: x["t"]).alias("ts"))
    return gathered.select("surface", F.when(F.size("ts") > 1, F.concat(F.lit("["), F.array_join("ts", ", "), F.lit("]"))).otherwise(F.col("ts")[0]).alias("value"))


def render_shards(values: DataFrame) -> DataFrame:
    """shard and its text: one entry a line, keys by code point."""
    line = F.concat(F.lit('  "'), F.col("surface"), F.lit('": '), F.col("value"))
    rows = values.select(shard_of(F.col("surface")).alias("shard"), "surface", line.alias("line"))
    joined = rows.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("surface", "line"))), lambda x: x["line"]).alias("lines"))
    return joined.select("shard", F.concat(F.lit("{\n"), F.array_join("lines", ",\n"), F.lit("\n}\n")).alias("text"))


def edit_entries(values: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """values (surface, value) with changed ones put in and removed ones gone."""
    kept = values.join(changed.select("surface").unionByName(removed.select("surface")).distinct(), "surface", "left_anti")
    return kept.unionByName(changed.select("surface", "value"))


def closure(wanted: DataFrame, entries: DataFrame, attested: DataFrame) -> DataFrame:
    """What adding entries asks for, one level down: each spelling named and whether it is registered, attested or unknown."""
    named = wanted.filter("spellings is not null").select("surface", F.explode("spellings").alias("target")).distinct()
    known = entries.select(F.col("surface").alias("target"), F.lit("resolved").alias("a")).distinct()
    seen = attested.select(F.col("surface").alias("target"), F.lit("prompt").alias("b")).distinct()
    return named.join(known, "target", "left").join(seen, "target", "left").select("surface", "target", F.coalesce("a", "b", F.lit("reject")).alias("state"))


def shards_of(rows: DataFrame) -> DataFrame:
    """Surfaces by the shard they belong in."""
    return rows.groupBy(shard_of(F.col("surface")).alias("shard")).agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))


def letters_of(rows: DataFrame, letter: str = "all") -> DataFrame:
    return rows if letter == "all" else rows.filter(letter_of(F.col("surface")) == letter)
