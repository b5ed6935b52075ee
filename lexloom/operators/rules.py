"""Validation rules: each takes the tables of a collection and gives violations(rule, path, locus, message, line)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import paths
from lexloom.functions.words import fold
from lexloom.operators import register as reg
from lexloom.session import small
from lexloom.sources import formatting
from lexloom.sources.marked import blocks_of, sections_of

VIOLATION = "rule string, path string, locus string, message string, line int"


@dataclass(frozen=True)
class Schema:
    types: dict[str, str]
    required: tuple[str, ...] = ()
    forms: dict[str, tuple[str, str]] | None = None


#: What metadata may hold, by entity.
AUTHOR = Schema(
    {"title": "string", "forename": "string", "surname": "string", "birth": "number", "death": "number", "nationality": "string", "sex": "string", "viaf": "string", "wikidata": "string"},
    ("forename", "surname", "birth", "death", "nationality", "sex"),
    {"viaf": (r"^[1-9]\d*$", "a VIAF cluster ID (digits)"), "wikidata": (r"^Q[1-9]\d*$", 'a Wikidata item ID ("Q" + digits)')},
)
TEXT = Schema(
    {
        "title": "string", "breadcrumb": "string", "authors": "string[]", "imported": "boolean", "published": "number[]", "canonical": "string", "standalone": "boolean",
        "sourceUrl": "string", "sourceDesc": "string", "estc": "string", "tcp": "string", "dictionary": "map",
    },
    ("title", "breadcrumb"),
    {
        "estc": (r"^[NPRSTW][1-9]\d*$", 'an ESTC citation number ("N", "P", "R", "S", "T" or "W" + digits)'),
        "tcp": (r"^(?:[ABN]\d{5}|K\d{6}\.\d{3})$", 'a TCP text ID ("A00002", "K000039.000")'),
    },
)
BLOCK = Schema({"pages": "string", "speaker": "string", "subsection": "string", "authors": "string[]"})
INHERITED = ("imported", "published")
STUB_ONLY = ("canonical", "standalone")
EDITION_ONLY = {"dictionary": "does not belong on a work's index.mit stub", "published": "is derived from editions, not set on the stub", "estc": "belongs on an edition, not on a work's index.mit stub", "tcp": "belongs on an edition, not on a work's index.mit stub"}

_QUOTED = '"%s"'


def _type_of(value: Column) -> Column:
    """The kind of a metadata value from its JSON text."""
    return (
        F.when(value.startswith('"'), "string").when(value.isin("true", "false"), "boolean").when(value.rlike(r"^-?\d"), "number")
        .when(value.rlike(r"^\[\s*\]$"), "[]").when(value.rlike(r'^\[\s*"'), "string[]").when(value.rlike(r"^\[\s*-?\d"), "number[]").when(value.startswith("{"), "map").otherwise("other")
    )


def text_value(value: Column) -> Column:
    """The text of a JSON string; null for other kinds."""
    return F.when(value.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), 0))


def list_value(value: Column) -> Column:
    """The strings of a JSON array of strings; a lone string is a list of one."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value.startswith('"'), F.array(text_value(value)))


def record_violations(records: DataFrame, key: str, schema: Schema) -> DataFrame:
    """key and message for unknown keys, wrong kinds, bad identifier forms and missing keys; metadata is map<string, JSON text>.

    The schema is a map literal, so a record is checked where it is, without a join.
    """
    types = F.create_map(*[F.lit(x) for kv in schema.types.items() for x in kv])
    forms = schema.forms or {}
    pattern = {k: p for k, (p, _) in forms.items()}
    quoted = F.concat(F.lit('"'), F.col("k"), F.lit('"'))
    kind, want = _type_of(F.col("v")), F.try_element_at(types, F.col("k"))
    fits = (kind == want) | ((kind == "[]") & want.endswith("[]"))
    message = F.when(want.isNull(), F.concat(F.lit("unknown key "), quoted)).when(~fits, F.concat(quoted, F.lit(" should be "), want))
    for k, (_, shape) in forms.items():
        wrong = (F.col("k") == k) & ~F.coalesce(text_value(F.col("v")).rlike(pattern[k]), F.lit(True))
        message = message.when(wrong, F.concat(quoted, F.lit(f" should be {shape}")))
    entries = records.select(key, F.explode("metadata").alias("k", "v")).select(key, message.alias("message")).filter("message is not null")
    missing = records.select(key, F.explode(F.array(*[F.when(~F.map_contains_key("metadata", F.lit(k)), F.lit(f'missing "{k}"')) for k in schema.required]) if schema.required else F.array().cast("array<string>")).alias("message"))
    return entries.unionByName(missing.filter("message is not null"))


def cleanly_compiled(parsed: DataFrame) -> DataFrame:
    """Parsed files without errors."""
    return parsed.filter(F.size("errors") == 0)


@dataclass
class Collection:
    """The tables rules read: parsed files, their sections and blocks, and the register."""

    parsed: DataFrame
    sections: DataFrame
    blocks: DataFrame
    entries: DataFrame | None = None
    listed: DataFrame | None = None
    pinned: DataFrame | None = None
    marked: DataFrame | None = None  # path, section_id, line, surface, value of [w:] tokens
    clean_sections: DataFrame | None = None
    clean_blocks: DataFrame | None = None
    shown: Callable[[Column], Column] = lambda surface: surface  # a surface as word lists have it

    @classmethod
    def of(cls, parsed: DataFrame, **more) -> Collection:
        """The collection of parsed files; sections and blocks are clean by their own file's errors, without a join."""
        clean = cleanly_compiled(parsed)
        return cls(parsed, sections_of(parsed), blocks_of(parsed), clean_sections=sections_of(clean, inherited=True), clean_blocks=blocks_of(clean), **more)

    def __post_init__(self) -> None:
        clean = cleanly_compiled(self.parsed).select("path")
        if self.clean_sections is None:
            self.clean_sections = self.sections.join(clean, "path", "left_semi")
        if self.clean_blocks is None:
            self.clean_blocks = self.blocks.join(clean, "path", "left_semi")
        self.roots = self.clean_sections.filter("ordinal = 0")


Check = Callable[[Collection], DataFrame]
RULES: dict[str, Check] = {}


def rule(name: str) -> Callable[[Check], Check]:
    def put(f: Check) -> Check:
        RULES[name] = f
        return f

    return put


def _out(df: DataFrame, message: Column, locus: Column | None = None, line: str | None = "line") -> DataFrame:
    return df.select("path", (locus if locus is not None else F.lit(None)).cast("string").alias("locus"), message.alias("message"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"))


def _in(column: str) -> Column:
    return F.concat(F.lit("("), F.col(column), F.lit(")"))


@rule("every file compiles without errors")
def compiles(c: Collection) -> DataFrame:
    rows = c.parsed.select("path", F.explode("errors").alias("e"))
    return rows.select("path", F.lit(None).cast("string").alias("locus"), F.col("e.message").alias("message"), F.col("e.line").alias("line"))


@rule("every file is formatted canonically")
def formatted(c: Collection) -> DataFrame:
    """Files that compile; the others have that to mend first."""
    swept = formatting.sweep(cleanly_compiled(c.parsed)).filter("changed")
    return _out(swept, F.lit("the file is not formatted canonically"), line=None)


@rule("author files match the author schema")
def author_schema(c: Collection) -> DataFrame:
    authors = c.roots.filter(paths.is_author_path(F.col("path")))
    bad = record_violations(authors.select("path", "metadata"), "path", AUTHOR)
    sex = authors.select("path", text_value(F.try_element_at("metadata", F.lit("sex"))).alias("sex")).filter("sex is not null and sex not in ('Male', 'Female')").select("path", F.lit('"sex" must be "Male" or "Female"').alias("message"))
    extra = c.clean_sections.filter(paths.is_author_path(F.col("path")) & (F.col("ordinal") > 0)).select("path", F.lit("author files have no sections").alias("message"))
    content = c.clean_blocks.filter(paths.is_author_path(F.col("path"))).select("path", F.lit("author files have no content").alias("message")).distinct()
    return _out(bad.unionByName(sex).unionByName(extra).unionByName(content).withColumn("line", F.lit(1)), F.col("message"))


@rule("texts match the text schema")
def text_schema(c: Collection) -> DataFrame:
    texts = c.clean_sections.filter(paths.is_work_path(F.col("path")) & F.col("ref").isNull())
    stub = paths.is_stub(F.col("path"), F.col("metadata"))
    in_file = ["inherited"] if "inherited" in texts.columns else []
    keyed = texts.select("path", "line", "id", "ancestors", "ordinal", "metadata", *in_file, stub.alias("stub"), F.struct("path", "id", "line").alias("at"))
    bad = record_violations(keyed.select("at", "metadata"), "at", TEXT).select("at.*", "message")
    lacks = lambda k: ~F.map_contains_key("metadata", F.lit(k))
    if in_file:
        have = keyed.filter("not stub").select("path", "id", "line", *[F.array_contains("inherited", k).alias(f"_{k}") for k in (*INHERITED, "authors")])
    else:
        held = keyed.select("path", F.col("id").alias("_a"), *[(~lacks(k)).alias(f"_{k}") for k in (*INHERITED, "authors")])
        chain = keyed.filter("not stub").select("path", "id", "line", F.explode(F.concat("ancestors", F.array("id"))).alias("_a")).join(held, ["path", "_a"])
        have = chain.groupBy("path", "id", "line").agg(*[F.max(f"_{k}").alias(f"_{k}") for k in (*INHERITED, "authors")])
    lost = have.select("path", "id", "line", F.explode(F.array(*[F.when(~F.col(f"_{k}"), F.lit(f'missing "{k}" (not inherited either)')) for k in (*INHERITED, "authors")])).alias("message")).filter("message is not null")
    unnamed = keyed.filter(F.col("stub") & lacks("authors")).select("path", "id", "line", F.lit('missing "authors"').alias("message"))
    misplaced = keyed.select("path", "id", "line", F.explode(F.array(
        *[F.when(~F.col("stub") & ~lacks(k), F.lit(f'"{k}" belongs only on a work\'s index.mit stub')) for k in STUB_ONLY],
        *[F.when(F.col("stub") & ~lacks(k), F.lit(f'"{k}" {why}')) for k, why in EDITION_ONLY.items()],
    )).alias("message")).filter("message is not null")
    return _out(bad.unionByName(lost).unionByName(unnamed).unionByName(misplaced), F.col("message"), _in("id"))


@rule("work stubs name a canonical edition that exists")
def stub_canonical(c: Collection) -> DataFrame:
    stubs = c.roots.filter(paths.is_stub(F.col("path"), F.col("metadata")))
    folder = F.regexp_replace("path", "/index\\.mit$", "")
    named = stubs.select("path", "line", folder.alias("dir"), text_value(F.col("metadata")["canonical"]).alias("canonical")).filter("canonical is not null")
    files = c.parsed.select(F.lower(F.regexp_replace("path", r"(?:/index)?\.mit$", "")).alias("_want")).distinct()
    lost = named.withColumn("_want", F.lower(F.concat_ws("/", "dir", "canonical"))).join(files, "_want", "left_anti")
    body = c.clean_blocks.join(stubs.select("path"), "path", "left_semi").groupBy("path").agg(F.min("start_line").alias("line")).select("path", F.lit(None).cast("string").alias("locus"), F.lit("a work stub holds metadata only").alias("message"), "line")
    return _out(lost, F.format_string('canonical "%s" has no edition in %s', "canonical", "dir")).unionByName(body)


@rule("block metadata matches the block schema")
def block_schema(c: Collection) -> DataFrame:
    keyed = c.clean_blocks.select(F.struct("path", "section_id", "block_id", F.col("start_line").alias("line")).alias("at"), "metadata")
    bad = record_violations(keyed, "at", BLOCK).select("at.*", "message")
    return _out(bad, F.col("message"), F.format_string("(%s {#%s})", "section_id", "block_id"))


@rule("every authors slug names a known author")
def known_authors(c: Collection) -> DataFrame:
    """Case counts here."""
    known = c.parsed.filter(paths.is_author_path(F.col("path"))).select(F.regexp_extract("path", r"([^/]+)\.mit$", 1).alias("slug"))
    of_texts = c.clean_sections.select("path", "line", _in("id").alias("locus"), F.explode(list_value(F.try_element_at("metadata", F.lit("authors")))).alias("slug"))
    of_blocks = c.clean_blocks.select("path", F.col("start_line").alias("line"), F.format_string("(%s) {#%s}", "section_id", "block_id").alias("locus"), F.explode(list_value(F.try_element_at("metadata", F.lit("authors")))).alias("slug"))
    lost = of_texts.unionByName(of_blocks).join(small(known), "slug", "left_anti")
    return _out(lost, F.format_string('unknown author "%s"', "slug"), F.col("locus"))


@rule("root IDs match file paths")
def root_ids(c: Collection) -> DataFrame:
    want = paths.expected_id(F.col("path"))
    return _out(c.roots.filter(F.lower("id") != F.lower(want)), F.format_string('root ID is "%s", expected "%s"', F.col("id"), want))


@rule("section headings are bare segments")
def bare_segments(c: Collection) -> DataFrame:
    segment = paths.heading_segment(F.col("id"), F.col("parent"))
    bad = c.clean_sections.filter("parent is not null and ref is null").withColumn("segment", segment).filter(F.contains("segment", F.lit(".")))
    return _out(bad, F.format_string('heading "%s" should be a bare segment (no dots)', "segment"), _in("id"))


@rule("borrowed-child references resolve to an edition")
def borrowed_refs(c: Collection) -> DataFrame:
    from lexloom.sources.files import resolve_paths

    refs = c.clean_sections.filter("ref is not null").select("path", "line", F.col("parent").alias("id"), "ref")
    lost = resolve_paths(refs, c.parsed.select("path")).filter("resolved is null")
    return _out(lost, F.format_string('unresolvable borrowed child "%s"', "ref"), _in("id"))


@rule("layout: lowercase names, index.mit in every directory")
def layout(c: Collection) -> DataFrame:
    files = c.parsed.select("path", F.split("path", "/").alias("p"))
    folders = files.filter(paths.is_work_path(F.col("path"))).select(F.explode(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))).alias("path"), "p").select("path").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    is_host = F.size(F.split("path", "/")) == 2
    odd = folders.filter(~F.when(is_host, name.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$")).otherwise(name.rlike(r"^[a-z0-9]+$") | paths.is_year_slug(name)))
    known = files.filter(paths.is_author_path(F.col("path"))).select(F.regexp_extract("path", r"([^/]+)\.mit$", 1).alias("part"))
    joint = folders.filter(is_host & name.contains("-")).select("path", F.explode(F.split(name, "-")).alias("part")).join(small(known), "part", "left_anti")
    index = files.filter(F.col("path").endswith("/index.mit")).select(F.regexp_replace("path", "/index\\.mit$", "").alias("path"))
    bare = folders.filter(F.size(F.split("path", "/")) >= 3).join(index, "path", "left_anti")
    years = folders.filter((F.size(F.split("path", "/")) == 3) & paths.is_year_slug(name))
    authors = files.filter(paths.is_author_path(F.col("path")) & ~F.col("path").rlike(r"^authors/[a-z0-9]+\.mit$")).select("path")
    none = lambda df, m: _out(df, m, line=None)
    return (
        none(odd, F.lit("name should be a lowercase slug")).unionByName(none(joint, F.format_string('joint host names unknown author "%s"', "part")))
        .unionByName(none(bare, F.lit("directory has no index.mit"))).unionByName(none(years, F.lit("an edition belongs in a work's directory"))).unionByName(none(authors, F.lit("author files are <slug>.mit")))
    )


def _empty(c: Collection) -> DataFrame:
    return c.parsed.sparkSession.createDataFrame([], "path string, locus string, message string, line int")


@rule("dictionary shards are well-formed")
def shards_well_formed(c: Collection) -> DataFrame:
    if c.entries is None:
        return _empty(c)
    rows = reg.structure_problems(c.entries)
    return _out(rows.withColumn("path", F.concat(F.lit("dictionary/"), "shard")), F.col("message"), F.concat(F.lit('"'), F.col("surface"), F.lit('"')), line=None)


def _sound(c: Collection) -> DataFrame | None:
    """Readings, if the shards have no structural problem."""
    return None if c.entries is None or not reg.structure_problems(c.entries).isEmpty() else reg.readings(c.entries)


@rule("dictionary readings resolve within the register")
def readings_resolve(c: Collection) -> DataFrame:
    rows = _sound(c)
    if rows is None:
        return _empty(c)
    bad = reg.violations(rows)
    return _out(bad.withColumn("path", F.concat(F.lit("dictionary/"), reg.shard_of(F.col("surface")))), F.col("message"), F.format_string(_QUOTED, "surface"), line=None)


@rule("canonical spelling matches the reference word list")
def canonical_spelling(c: Collection) -> DataFrame:
    rows = _sound(c)
    if rows is None or c.listed is None:
        return _empty(c)
    pinned = c.pinned if c.pinned is not None else c.listed.limit(0)
    bad = reg.canonical_spelling(rows, c.listed, pinned, c.shown)
    message = F.when(F.col("expected").isNull(), F.lit("no member of the class is in the reference word list")).otherwise(F.format_string('"%s" should be the canonical spelling, not "%s"', "expected", "canonical"))
    return _out(bad.withColumn("path", F.concat(F.lit("dictionary/"), reg.shard_of(F.col("canonical")))), message, F.format_string(_QUOTED, "canonical"), line=None)


@rule("word markup selects a dictionary reading")
def word_markup(c: Collection) -> DataFrame:
    rows = _sound(c)
    if rows is None or c.marked is None:
        return _empty(c)
    of = reg.by_surface(reg.expand(rows))
    bad = c.marked.withColumn("surface", fold(F.col("surface"))).join(of, "surface", "left").withColumn("message", reg.selection_violation(F.col("surface"), F.col("of"), F.col("value"), "[w:] is"))
    return _out(bad.filter("message is not null"), F.col("message"), _in("section_id"))


@rule("dictionary overrides select a reading")
def overrides(c: Collection) -> DataFrame:
    rows = _sound(c)
    if rows is None:
        return _empty(c)
    of = reg.by_surface(reg.expand(rows))
    named = c.clean_sections.select("path", "line", "id", F.explode("dictionary").alias("surface", "value"))
    bad = named.join(of, "surface", "left").withColumn("message", reg.override_violation(F.col("surface"), F.col("of"), F.col("value")))
    return _out(bad.filter("message is not null"), F.col("message"), _in("id"))


def validate(c: Collection, names: list[str] | None = None) -> DataFrame:
    """Violations of all rules (or the named ones), with the rule's place in order; checks share the collection's tables."""
    out = None
    for k, (name, check) in enumerate(RULES.items()):
        if names is None or name in names:
            rows = check(c).select(F.lit(k).alias("rule_ord"), F.lit(name).alias("rule"), "path", "locus", "message", "line")
            out = rows if out is None else out.unionByName(rows)
    return out
