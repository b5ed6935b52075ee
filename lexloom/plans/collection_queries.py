"""Queries over the made collection: parsing, validation rules, layout and records, each with SQL from the keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import paths, words
from lexloom.operators import rules, scan
from lexloom.plans import made
from lexloom.plans.made import MADE_SQL
from lexloom.session import kept
from lexloom.sources import files as sources
from lexloom.sources import formatting, marked, wire

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def _with(sql: str) -> str:
    return f"WITH {MADE_SQL}\n{sql}"


def collection(spark, sf_dir, *kinds, **more) -> rules.Collection:
    parsed = made.parsed(spark, sf_dir, *kinds)
    return rules.Collection(parsed, marked.sections_of(parsed), marked.blocks_of(parsed), **more)


_FIELDS = "(5 + CASE WHEN n % 7 <> 3 THEN 1 ELSE 0 END + CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END)"


@query(
    _with(
        f"""SELECT path, 'A' || n AS id, CAST(NULL AS VARCHAR) AS parent, 1 AS depth, 0 AS ordinal, 1 AS line, CAST(NULL AS VARCHAR) AS ref, 'A' || n AS segment FROM a
UNION ALL SELECT path, 'A' || n || '.Extra', 'A' || n, 2, 1, CAST({_FIELDS} + 5 AS INTEGER), NULL, 'Extra' FROM a WHERE n % 8 = 6
UNION ALL SELECT path, id, NULL, 1, 0, 1, NULL, id FROM w WHERE has_stub
UNION ALL SELECT path, id, NULL, 1, 0, 1, NULL, id FROM e
UNION ALL SELECT path, sid, id, 2, 1, l1, NULL, '1' FROM e
UNION ALL SELECT path, sid || '.x.y', sid, 3, 2, l2, NULL, 'x.y' FROM e WHERE nested
UNION ALL SELECT path, id || '.<' || ref || '>', id, 2, CASE WHEN nested THEN 3 ELSE 2 END, l3, ref, '<' || ref || '>' FROM e WHERE borrows"""
    )
)
def parsed_sections(spark, sf_dir):
    rows = wire.skeletons(marked.sections_of(made.parsed(spark, sf_dir)))
    ref = paths.borrowed_ref(F.col("id"))
    return rows.select("path", "id", "parent", "depth", "ordinal", "line", ref.alias("ref"), paths.heading_segment(F.col("id"), F.col("parent")).alias("segment")).withColumn("segment", F.coalesce("segment", "id"))


@query(
    _with(
        """SELECT path, sid AS section_id, 0 AS block_ordinal, '1' AS block_id, '"' || (k % 100) || '"' AS pages,
       'The [p:Ada] saw $fr:le roi$ and [w:was=be] ' || status || k || ' [-old-][+new+] of[l: Rome] end.' AS raw, l1 + 6 AS start_line FROM e"""
    )
)
def source_blocks(spark, sf_dir):
    rows = marked.blocks_of(made.parsed(spark, sf_dir, made.edition_files))
    return rows.select("path", "section_id", "block_ordinal", "block_id", F.col("metadata")["pages"].alias("pages"), "raw", "start_line")


_TOKENS = """t AS (SELECT path, sid AS section_id, l1 + 7 AS line, unnest([
  {'pos': 0, 'version': 'edited', 'text': 'The', 'exemption': NULL, 'word': NULL}, {'pos': 1, 'version': 'edited', 'text': 'Ada', 'exemption': 'person', 'word': NULL},
  {'pos': 2, 'version': 'edited', 'text': 'saw', 'exemption': NULL, 'word': NULL}, {'pos': 3, 'version': 'edited', 'text': 'le', 'exemption': 'language', 'word': NULL},
  {'pos': 4, 'version': 'edited', 'text': 'roi', 'exemption': 'language', 'word': NULL}, {'pos': 5, 'version': 'edited', 'text': 'and', 'exemption': NULL, 'word': NULL},
  {'pos': 6, 'version': 'edited', 'text': 'was', 'exemption': NULL, 'word': 'be'}, {'pos': 7, 'version': 'edited', 'text': status || k, 'exemption': NULL, 'word': NULL},
  {'pos': 8, 'version': 'edited', 'text': 'new', 'exemption': NULL, 'word': NULL}, {'pos': 9, 'version': 'edited', 'text': 'of', 'exemption': NULL, 'word': NULL},
  {'pos': 10, 'version': 'edited', 'text': 'Rome', 'exemption': 'place', 'word': NULL}, {'pos': 11, 'version': 'edited', 'text': 'end', 'exemption': NULL, 'word': NULL},
  {'pos': 12, 'version': 'original', 'text': 'old', 'exemption': NULL, 'word': NULL}], recursive := true) FROM e)"""


@query(f"WITH {MADE_SQL}, {_TOKENS} SELECT path, section_id, pos, version, text, exemption, word, line FROM t")
def block_tokens(spark, sf_dir):
    rows = marked.tokens_of(marked.blocks_of(made.parsed(spark, sf_dir, made.edition_files)))
    return rows.select("path", "section_id", "pos", "version", "text", "exemption", "word", "line")


@query(f"WITH {MADE_SQL}, {_TOKENS} SELECT coalesce(exemption, 'none') AS exemption, count(*) AS tokens, count(DISTINCT text) AS texts FROM t GROUP BY 1")
def exempt_tokens(spark, sf_dir):
    """Exemptions by the innermost frame that exempts, for tokens in nested frames."""
    rows = marked.tokens_of(marked.blocks_of(made.parsed(spark, sf_dir, made.edition_files)))
    context = F.array(F.struct(F.lit("emphasis").alias("type")), F.struct(F.coalesce("exemption", F.lit("quote")).alias("type")), F.struct(F.lit("bold").alias("type")))
    return rows.groupBy(F.coalesce(words.exemption_of(context), F.lit("none")).alias("exemption")).agg(F.count("*").alias("tokens"), F.countDistinct("text").alias("texts"))


def _rule(name: str, sql: str, *kinds):
    def put(f):
        def run(spark, sf_dir) -> DataFrame:
            return rules.validate(collection(spark, sf_dir, *kinds), [name]).select("path", "locus", "message", "line")

        run.__name__ = f.__name__
        QUERIES[f.__name__] = (run, _with(sql))
        return run

    return put


_NONE = "CAST(NULL AS VARCHAR)"


@_rule("every file compiles without errors", f"SELECT path, {_NONE} AS locus, 'malformed metadata' AS message, CAST(3 + m AS INTEGER) AS line FROM e WHERE NOT clean", made.edition_files)
def rule_compiles(): ...


@_rule(
    "every file is formatted canonically",
    f"""SELECT path, {_NONE} AS locus, 'the file is not formatted canonically' AS message, CAST(NULL AS INTEGER) AS line FROM e
WHERE clean AND NOT borrows""",
    made.edition_files,
)
def rule_formatted(): ...


@_rule(
    "author files match the author schema",
    f"""SELECT path, {_NONE} AS locus, message, 1 AS line FROM (
SELECT path, 'missing "surname"' AS message FROM a WHERE n % 7 = 3 UNION ALL SELECT path, '"birth" should be number' FROM a WHERE n % 5 = 4
UNION ALL SELECT path, '"sex" must be "Male" or "Female"' FROM a WHERE n % 6 = 5 UNION ALL SELECT path, '"viaf" should be a VIAF cluster ID (digits)' FROM a WHERE n % 4 = 1
UNION ALL SELECT path, 'author files have no sections' FROM a WHERE n % 8 = 6 UNION ALL SELECT path, 'author files have no content' FROM a WHERE n % 9 = 7)""",
    made.author_files,
)
def rule_author_schema(): ...


_M4 = """SELECT path, '(' || id || ')' AS locus, 'missing "authors"' AS message, 1 AS line FROM w WHERE has_stub AND c % 4 = 0 AND c % 9 <> 0
UNION ALL SELECT path, '(' || id || ')', '"published" is derived from editions, not set on the stub', 1 FROM w WHERE has_stub AND c % 11 = 0
UNION ALL SELECT path, '(' || id || ')', 'missing "breadcrumb"', 1 FROM e WHERE clean AND k % 7 = 2
UNION ALL SELECT path, '(' || id || ')', '"standalone" belongs only on a work''s index.mit stub', 1 FROM e WHERE clean AND k % 17 = 3
UNION ALL SELECT path, '(' || id || ')', 'missing "imported" (not inherited either)', 1 FROM e WHERE clean AND k % 6 = 1
UNION ALL SELECT path, '(' || sid || ')', 'missing "imported" (not inherited either)', l1 FROM e WHERE clean AND k % 6 = 1
UNION ALL SELECT path, '(' || sid || '.x.y)', 'missing "imported" (not inherited either)', l2 FROM e WHERE clean AND k % 6 = 1 AND nested"""


@_rule("texts match the text schema", _M4, made.stub_files, made.edition_files)
def rule_text_schema(): ...


@_rule(
    "work stubs name a canonical edition that exists",
    f"""SELECT path, {_NONE} AS locus, 'canonical "1700" has no edition in ' || dir AS message, 1 AS line FROM w WHERE has_stub AND (c % 5 = 0 OR c NOT IN (SELECT c FROM e))
UNION ALL SELECT path, NULL, 'a work stub holds metadata only',
  CAST(8 + CASE WHEN c % 9 = 0 OR c % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN c % 6 = 5 THEN 1 ELSE 0 END + CASE WHEN c % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) FROM w WHERE has_stub AND c % 13 = 0""",
    made.stub_files, made.edition_files,
)
def rule_stub_canonical(): ...


@_rule("block metadata matches the block schema", "SELECT path, '(' || sid || ' {#1})' AS locus, 'unknown key \"mood\"' AS message, l1 + 6 AS line FROM e WHERE clean AND k % 23 = 6", made.edition_files)
def rule_block_schema(): ...


@_rule(
    "every authors slug names a known author",
    """SELECT path, '(' || id || ')' AS locus, 'unknown author "zz"' AS message, 1 AS line FROM w WHERE has_stub AND c % 9 = 0
UNION ALL SELECT path, '(' || sid || ') {#1}', 'unknown author "yy"', l1 + 6 FROM e WHERE clean AND k % 29 = 7""",
)
def rule_known_authors(): ...


@_rule("root IDs match file paths", f"SELECT path, {_NONE} AS locus, 'root ID is \"' || id || '\", expected \"' || host || '.w' || c || '\"' AS message, 1 AS line FROM w WHERE has_stub AND c % 8 = 1")
def rule_root_ids(): ...


@_rule("section headings are bare segments", "SELECT path, '(' || sid || '.x.y)' AS locus, 'heading \"x.y\" should be a bare segment (no dots)' AS message, l2 AS line FROM e WHERE clean AND nested", made.edition_files)
def rule_bare_segments(): ...


@_rule("borrowed-child references resolve to an edition", "SELECT path, '(' || id || ')' AS locus, 'unresolvable borrowed child \"' || ref || '\"' AS message, l3 AS line FROM e WHERE clean AND borrows AND NOT resolves", made.edition_files)
def rule_borrowed_refs(): ...


@_rule(
    "layout: lowercase names, index.mit in every directory",
    f"""SELECT DISTINCT 'works/' || host AS path, {_NONE} AS locus, 'name should be a lowercase slug' AS message, CAST(NULL AS INTEGER) AS line FROM w WHERE c % 50 = 7 AND (has_stub OR c IN (SELECT c FROM e))
UNION ALL SELECT DISTINCT 'works/' || host, NULL, 'joint host names unknown author "' || part || '"', NULL
  FROM (SELECT host, unnest(string_split(host, '-')) AS part FROM w WHERE contains(host, '-') AND (has_stub OR c IN (SELECT c FROM e))) WHERE part NOT IN (SELECT 'a' || n FROM a)
UNION ALL SELECT dir, NULL, 'directory has no index.mit', NULL FROM w WHERE NOT has_stub AND c IN (SELECT c FROM e)""",
)
def rule_layout(): ...


@query(
    _with(
        f"""SELECT path, count(*) AS total FROM (SELECT path, message FROM ({_M4}) UNION ALL SELECT path, 'e' FROM e WHERE NOT clean
UNION ALL SELECT path, 'n' FROM e WHERE clean AND nested UNION ALL SELECT path, 'r' FROM e WHERE clean AND borrows AND NOT resolves UNION ALL SELECT path, 'f' FROM e WHERE clean AND NOT borrows) GROUP BY path"""
    )
)
def violations_of_collection(spark, sf_dir):
    """Several rules at once, grouped by file."""
    names = ["every file compiles without errors", "every file is formatted canonically", "texts match the text schema", "section headings are bare segments", "borrowed-child references resolve to an edition"]
    c = rules.Collection.of(kept(made.parsed(spark, sf_dir, made.stub_files, made.edition_files)))
    return rules.validate(c, names).groupBy("path").agg(F.count("*").alias("total"))


@query(_with("SELECT path, path IN (SELECT path FROM e WHERE borrows) AS formatted FROM e"))
def formatter_sweep(spark, sf_dir):
    swept = formatting.sweep(made.edition_files(spark, sf_dir))
    return swept.select("path", (~F.col("changed")).alias("formatted"))


@query(
    _with(
        """SELECT path, 'author' AS kind, 'a' || n AS slug, 'a' || n || '.mit' AS last FROM a UNION ALL SELECT path, 'stub', 'w' || c, 'index.mit' FROM w WHERE has_stub
UNION ALL SELECT path, 'edition', slug, slug || '.mit' FROM e"""
    )
)
def catalogue_layout(spark, sf_dir):
    return sources.layout(made.files(spark, sf_dir)).select("path", "kind", "slug", F.element_at(F.split("path", "/"), -1).alias("last"))


@query(
    _with(
        """SELECT path, 'a' || n AS expected, false AS is_work, false AS is_stub, path AS plain FROM a
UNION ALL SELECT path, host || '.w' || c, true, true, path FROM w WHERE has_stub
UNION ALL SELECT path, host || '.w' || c || '.' || slug, true, false, path FROM e"""
    )
)
def ids_of_paths(spark, sf_dir):
    root = marked.sections_of(made.parsed(spark, sf_dir)).filter("ordinal = 0")
    odd = F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("//x/../")))
    return root.select(
        "path", paths.expected_id(F.col("path")).alias("expected"), (paths.is_work_path(F.col("path")) & ~paths.is_author_path(F.col("path"))).alias("is_work"),
        F.coalesce(paths.is_stub(F.col("path"), F.col("metadata")), F.lit(False)).alias("is_stub"), paths.normalize_path(odd).alias("plain"),
    )


@query(_with("SELECT path, ref, CASE WHEN resolves THEN ref_path END AS resolved FROM e WHERE borrows"))
def resolved_paths(spark, sf_dir):
    refs = marked.sections_of(made.parsed(spark, sf_dir, made.edition_files)).filter("ref is not null").select("path", "ref")
    return sources.resolve_paths(refs, made.edition_files(spark, sf_dir).select("path")).select("path", "ref", "resolved")


_HASH = "WITH {made}, {tokens}, s AS (SELECT path, CASE WHEN text = 'I' THEN text ELSE lower(text) END AS surface, exemption FROM t)"


@query(
    _HASH.format(made=MADE_SQL, tokens=_TOKENS)
    + r"""SELECT path, count(DISTINCT surface) FILTER (WHERE exemption IS NULL AND NOT regexp_matches(surface, '\d')) AS surfaces,
       string_agg(DISTINCT surface, ' ' ORDER BY surface) FILTER (WHERE exemption IS NOT NULL) AS exempt, 1 AS version FROM s GROUP BY path"""
)
def source_records(spark, sf_dir):
    """Records of sources, made, and read back from their wire columns."""
    parsed = made.parsed(spark, sf_dir, made.edition_files)
    none = rules.validate(rules.Collection(parsed, marked.sections_of(parsed), marked.blocks_of(parsed)), ["every file compiles without errors"])
    records = wire.source_records(parsed.select("path", "text"), marked.tokens_of(marked.blocks_of(parsed)), none, "root")
    return records.select("path", F.size("surfaces").cast("long").alias("surfaces"), F.array_join("exempt_surfaces", " ").alias("exempt"), "version")


@query(f"WITH {MADE_SQL}, {_TOKENS} SELECT path, text, 'was be' AS unit FROM t WHERE text = 'never' UNION ALL SELECT path, text, CASE WHEN text IN ('new', 'of') THEN 'new of' END FROM t WHERE version = 'edited' AND exemption IS NULL AND word IS NULL AND text NOT LIKE '%' || regexp_extract(path, '-0*(\\d+)', 1) || '%' AND text NOT IN ('The', 'and') AND NOT regexp_matches(text, '\\d')")
def unaccounted_occurrences(spark, sf_dir):
    """Every unaccounted token with the registered unit that it could belong to."""
    rows = marked.tokens_in_blocks(marked.blocks_of(made.parsed(spark, sf_dir, made.edition_files)), original=False)
    register = spark.createDataFrame([("the",), ("and",), ("new of",)], "surface string")
    return scan.occurrences_in_blocks(rows, register).select("path", "text", F.col("fuse").alias("unit"))


@query(
    _with(
        """SELECT path, CAST(CASE WHEN borrows THEN l3 WHEN nested THEN l2 + 4 ELSE l1 + 7 END AS BIGINT) AS lines, CAST(1 + nested::INT + borrows::INT AS BIGINT) AS sections, 1::BIGINT AS blocks,
CAST(NOT clean AS BIGINT) AS diagnostics FROM e"""
    )
)
def import_reports(spark, sf_dir):
    rows = wire.parsed_report(made.parsed(spark, sf_dir, made.edition_files))
    return rows.select("path", F.col("lines").cast("long").alias("lines"), F.col("sections").cast("long").alias("sections"), F.col("blocks").cast("long").alias("blocks"), F.col("diagnostics").cast("long").alias("diagnostics"))


@query(_with("SELECT path, CAST(count(*) AS BIGINT) AS lines FROM (SELECT path FROM e) GROUP BY path"))
def searchable_lines(spark, sf_dir):
    from lexloom.operators import search

    parsed = made.parsed(spark, sf_dir, made.edition_files)
    return search.searchable_lines(parsed.select("path", "text"), marked.blocks_of(parsed)).groupBy("path").agg(F.count("*").alias("lines"))


@query(_with("SELECT e.path, count(*) AS nodes, sum(CASE WHEN resolves THEN 1 ELSE 0 END)::BIGINT AS refs FROM (SELECT path, resolves FROM e UNION ALL SELECT path, false FROM e UNION ALL SELECT path, false FROM e WHERE nested UNION ALL SELECT path, false FROM e WHERE resolves) e GROUP BY e.path"))
def document_json(spark, sf_dir):
    """Documents as JSON: nodes kept, and those that are references."""
    parsed = made.parsed(spark, sf_dir, made.edition_files)
    sections = marked.sections_of(parsed)
    keys = sections.filter("ordinal = 0").select(F.col("id").alias("doc_id"), F.col("path").alias("doc_key"))
    rows = wire.documents_json(sections, keys).select("path", F.from_json("json", "array<struct<id string, __ref string>>").alias("nodes"))
    return rows.select("path", F.size("nodes").cast("long").alias("nodes"), F.size(F.filter("nodes", lambda x: x["__ref"].isNotNull())).cast("long").alias("refs"))
