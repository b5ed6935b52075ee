"""Queries over the text tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import words as w
from lexloom.operators import accounting as acc
from lexloom.operators import mining, register, search
from lexloom.session import small
from lexloom.streaming import incremental

TOKEN_SQL = w.TOKEN.replace("'", "''")
SURFACE_SQL = "CASE WHEN t = 'I' THEN t ELSE lower(t) END"
MECHANICAL_SQL = rf"(regexp_matches(surface, '\p{{N}}') OR (surface <> '' AND regexp_matches(lower(surface), '{w.ROMAN}')))"
BASE_SQL = "nullif(regexp_extract(surface, '^(.+)[''’]s$', 1), '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Documents and, as one more source, the benchmark's texts with 's behind each word, for no document has a possessive.
POSSESSED_SQL = "(SELECT source, text FROM documents UNION ALL SELECT 'possessives', replace(text, ' ', chr(39) || 's ') FROM benchmark) AS x"


def possessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "benchmark").select(F.lit("possessives").alias("source"), F.replace("text", F.lit(" "), F.lit("'s ")).alias("text"))
    return docs(spark, sf_dir).select("source", "text").unionByName(made)


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.register_of(table(spark, sf_dir, "benchmark"))


def _tok(columns: str = "", source: str = "documents", name: str = "tok") -> str:
    cols = f"{columns}, " if columns else ""
    return f"{name} AS (SELECT {cols}{SURFACE_SQL} AS surface FROM (SELECT {cols}unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS t FROM {source}))"


_REG = _tok(source="benchmark", name="bt") + ", reg AS (SELECT DISTINCT surface FROM bt)"
_STATUS = f"""stat AS (
  SELECT c.*, CASE WHEN r.surface IS NOT NULL THEN 'registered' WHEN b.surface IS NOT NULL THEN 'possessive'
              WHEN {MECHANICAL_SQL.replace("surface", "c.surface")} THEN 'mechanical' ELSE 'unaccounted' END AS status
  FROM (SELECT *, {BASE_SQL} AS base FROM cnt) c
  LEFT JOIN reg r ON c.surface = r.surface LEFT JOIN reg b ON c.base = b.surface)"""

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS BIGINT) AS n_tokens FROM documents")
def token_count_by_document(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(w.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {_tok()} SELECT surface, count(*) AS n FROM tok GROUP BY surface")
def surface_frequency(spark, sf_dir):
    return acc.surface_counts(docs(spark, sf_dir))


@query(f"SELECT t AS text, {SURFACE_SQL} AS folded, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS t FROM documents) GROUP BY t")
def fold_surfaces(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.explode(w.tokens(F.col("text"))).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return rows.select("text", w.fold(F.col("text")).alias("folded"), "n")


@query(f"WITH {_tok(source=POSSESSED_SQL)} SELECT surface, {BASE_SQL} AS base, count(*) AS n FROM tok WHERE {BASE_SQL} IS NOT NULL GROUP BY surface")
def possessive_bases(spark, sf_dir):
    rows = acc.surface_counts(possessed(spark, sf_dir)).withColumn("base", w.possessive_base(F.col("surface")))
    return rows.filter("base is not null").select("surface", "base", "n")


@query(rf"WITH {_tok()} SELECT surface, count(*) AS n, NOT regexp_matches(surface, '\p{{N}}') AS roman FROM tok WHERE {MECHANICAL_SQL} GROUP BY surface")
def mechanical_tokens(spark, sf_dir):
    rows = acc.surface_counts(docs(spark, sf_dir)).filter(w.is_mechanical(F.col("surface")))
    return rows.select("surface", "n", (~F.col("surface").rlike(r"\p{N}")).alias("roman"))


@query(
    rf"""WITH {_tok()}, l AS (SELECT surface, lower(regexp_extract(surface, '\p{{L}}')) AS c FROM tok)
SELECT CASE WHEN c BETWEEN 'a' AND 'z' THEN c || '.json' ELSE 'other.json' END AS shard, count(DISTINCT surface) AS surfaces, count(*) AS tokens FROM l GROUP BY 1"""
)
def shard_letters(spark, sf_dir):
    rows = acc.surface_counts(docs(spark, sf_dir))
    return rows.groupBy(w.shard_of(F.col("surface")).alias("shard")).agg(F.count("*").alias("surfaces"), F.sum("n").alias("tokens"))


@query(
    f"""WITH {_tok("source", POSSESSED_SQL)}, {_REG}, cnt AS (SELECT source, surface, count(*) AS n FROM tok GROUP BY ALL), {_STATUS}
SELECT source, status, CAST(sum(n) AS BIGINT) AS n FROM stat GROUP BY source, status"""
)
def accounting_status(spark, sf_dir):
    counts = acc.surface_counts(possessed(spark, sf_dir), "source")
    return acc.with_status(counts, reg(spark, sf_dir)).groupBy("source", "status").agg(F.sum("n").alias("n"))


@query(
    f"""WITH {_tok("source")}, {_REG}, cnt AS (SELECT source, surface, count(*) AS n FROM tok GROUP BY ALL), {_STATUS}
SELECT source, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN status <> 'unaccounted' THEN n ELSE 0 END) AS BIGINT) AS accounted,
       CAST(sum(CASE WHEN status = 'unaccounted' THEN n ELSE 0 END) AS BIGINT) AS unaccounted
FROM stat GROUP BY ROLLUP (source)"""
)
def coverage_by_work(spark, sf_dir):
    return acc.coverage(acc.with_status(acc.surface_counts(docs(spark, sf_dir), "source"), reg(spark, sf_dir)), "source")


_BACKLOG = f"""{_tok("doc_id")}, {_REG}, cnt AS (SELECT surface, count(*) AS n, min(doc_id) AS example FROM tok WHERE NOT {MECHANICAL_SQL} GROUP BY surface), {_STATUS},
un AS (SELECT surface, n, example FROM stat WHERE status = 'unaccounted')"""


def _backlog(spark, sf_dir):
    return acc.backlog(acc.token_index(docs(spark, sf_dir), "doc_id"), reg(spark, sf_dir))


@query(f"WITH {_BACKLOG} SELECT surface, n, example, (SELECT count(*) FROM un) AS total FROM un ORDER BY n DESC, surface LIMIT 2000")
def curation_topk(spark, sf_dir):
    return acc.top(_backlog(spark, sf_dir), 2000)


@query(f"WITH {_BACKLOG}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, surface) AS rank FROM un) SELECT surface, n, example, CAST(rank AS INTEGER) AS rank FROM r WHERE rank > 50 AND rank <= 100")
def curation_page(spark, sf_dir):
    return acc.page(_backlog(spark, sf_dir), 1)


@query(f"WITH {_tok()}, u AS (SELECT surface FROM tok WHERE NOT {MECHANICAL_SQL} UNION SELECT surface FROM ({f'WITH {_tok(source='conversations')} SELECT surface FROM tok'}) WHERE NOT {MECHANICAL_SQL}) SELECT surface FROM u")
def attested_vocabulary(spark, sf_dir):
    both = acc.surface_counts(docs(spark, sf_dir)).select("surface").unionByName(acc.surface_counts(table(spark, sf_dir, "conversations")).select("surface"))
    return both.filter(~w.is_mechanical(F.col("surface"))).distinct()


@query(
    f"""WITH {_tok("role", "conversations")}
SELECT surface, count(*) AS n FROM (SELECT surface FROM tok WHERE role = 'user' EXCEPT ALL SELECT surface FROM tok WHERE role = 'assistant') GROUP BY surface"""
)
def surplus_tokens(spark, sf_dir):
    # as sums of counts: the same multiset difference without a row for each token
    rows = acc.surface_counts(table(spark, sf_dir, "conversations"), "role")
    left = F.sum(F.when(F.col("role") == "user", F.col("n")).when(F.col("role") == "assistant", -F.col("n")).otherwise(0))
    return rows.groupBy("surface").agg(left.alias("n")).filter("n > 0")


@query(f"WITH {_tok('lang')}, v AS (SELECT DISTINCT surface, lang FROM tok WHERE lang IN ('en', 'fr')) SELECT surface, min(lang) AS lang FROM v GROUP BY surface HAVING count(*) = 1")
def vocabulary_symdiff(spark, sf_dir):
    rows = acc.surface_counts(docs(spark, sf_dir).filter(F.col("lang").isin("en", "fr")), "lang")
    return rows.groupBy("surface").agg(F.min("lang").alias("lang"), F.count("*").alias("k")).filter("k = 1").select("surface", "lang")


_READ = f"""{_REG}, good AS (SELECT surface FROM reg WHERE regexp_matches(surface, '^[''’]*\\p{{L}}['’\\p{{L}}]*$')),
raw AS (
  SELECT g.surface, CASE WHEN s.surface IS NOT NULL THEN 's' WHEN e.surface IS NOT NULL THEN 'e' ELSE 'i' END AS kind, coalesce(s.surface, e.surface) AS stem
  FROM good g LEFT JOIN good s ON length(g.surface) > 2 AND right(g.surface, 1) = 's' AND s.surface = left(g.surface, length(g.surface) - 1)
  LEFT JOIN good e ON length(g.surface) > 3 AND right(g.surface, 2) = 'ed' AND e.surface = left(g.surface, length(g.surface) - 2)),
readings AS (
  SELECT surface, 0 AS reading_ord, surface AS lemma, CAST(NULL AS VARCHAR) AS spelling FROM raw WHERE kind IN ('i', 'e')
  UNION ALL SELECT surface, CASE WHEN kind = 'e' THEN 1 ELSE 0 END, NULL, stem FROM raw WHERE kind IN ('s', 'e'))""".replace("['’\\p", "[''’\\p")


def _readings(spark, sf_dir):
    """A register by rule from the benchmark's surfaces: plurals refer to their stem, participles are ambiguous with theirs."""
    good = reg(spark, sf_dir).filter(F.col("surface").rlike(r"^['’]*\p{L}['’\p{L}]*$"))
    n = F.char_length("surface")
    stems = good.select(F.col("surface").alias("stem"))
    rows = good.withColumn("s_stem", F.when((n > 2) & F.col("surface").endswith("s"), F.left("surface", n - 1))).withColumn("e_stem", F.when((n > 3) & F.col("surface").endswith("ed"), F.left("surface", n - 2)))
    rows = rows.join(stems.select(F.col("stem").alias("s_stem"), F.lit(True).alias("s")), "s_stem", "left").join(stems.select(F.col("stem").alias("e_stem"), F.lit(True).alias("e")), "e_stem", "left")
    identity = F.struct(F.col("surface").alias("lemma"), F.lit(None).cast("array<string>").alias("spellings"))
    cross = lambda stem: F.struct(F.lit(None).cast("string").alias("lemma"), F.array(stem).alias("spellings"))
    choice = F.when(F.col("s"), F.array(cross("s_stem"))).when(F.col("e"), F.array(identity, cross("e_stem"))).otherwise(F.array(identity))
    return rows.select("surface", F.posexplode(choice).alias("reading_ord", "r")).select("surface", "reading_ord", "r.lemma", "r.spellings")


@query(f"WITH {_READ} SELECT surface, CAST(reading_ord AS INTEGER) AS reading_ord, coalesce(spelling, surface) AS spelling, coalesce(lemma, spelling) AS lemma FROM readings")
def register_expand(spark, sf_dir):
    return register.expand(_readings(spark, sf_dir)).select("surface", "reading_ord", "spelling", "lemma")


@query(f"WITH {_READ}, x AS (SELECT DISTINCT coalesce(spelling, surface) AS sp, coalesce(lemma, spelling) AS lemma FROM readings) SELECT lemma, string_agg(sp, ' ' ORDER BY sp) AS forms, lemma IN (SELECT surface FROM readings) AS headword FROM x GROUP BY lemma")
def lemma_paradigms(spark, sf_dir):
    return register.paradigms(register.expand(_readings(spark, sf_dir))).select("lemma", F.array_join("forms", " ").alias("forms"), "headword")


@query(
    f"""WITH {_READ}, amb AS (SELECT surface, max(spelling) AS stem FROM readings GROUP BY surface HAVING count(*) > 1),
k AS (SELECT DISTINCT surface FROM readings)
SELECT k.surface, coalesce(CASE WHEN length(k.surface) % 2 = 0 THEN amb.stem END, (SELECT coalesce(r.lemma, r.spelling) FROM readings r WHERE r.surface = k.surface AND r.reading_ord = 0)) AS lemma
FROM k LEFT JOIN amb USING (surface)"""
)
def reading_resolution(spark, sf_dir):
    rows = _readings(spark, sf_dir)
    stem = F.max(F.array_join("spellings", " "))
    marked = rows.groupBy("surface").agg(F.count("*").alias("n"), stem.alias("stem")).select("surface", F.when((F.col("n") > 1) & (F.char_length("surface") % 2 == 0), F.col("stem")).alias("marked"), F.lit("no such value").alias("override"))
    return register.resolve(marked, register.expand(rows)).select("surface", F.col("reading.lemma").alias("lemma"))


@query(f"WITH {_READ}, v AS (SELECT surface, CASE WHEN count(*) > 1 THEN '[null, \"' || max(spelling) || '\"]' WHEN max(lemma) IS NOT NULL THEN 'null' ELSE '\"' || max(spelling) || '\"' END AS value FROM readings GROUP BY surface), l AS (SELECT *, lower(regexp_extract(surface, '\\p{{L}}')) AS c FROM v) SELECT CASE WHEN c BETWEEN 'a' AND 'z' THEN c || '.json' ELSE 'other.json' END AS shard, md5('{{' || chr(10) || string_agg('  \"' || surface || '\": ' || value, ',' || chr(10) ORDER BY surface) || chr(10) || '}}' || chr(10)) AS digest FROM l GROUP BY 1")
def shard_render(spark, sf_dir):
    return register.render_shards(register.entry_json(_readings(spark, sf_dir))).select("shard", F.md5("text").alias("digest"))


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(coalesce(text, ''), '([^\p{{L}}\p{{N}}])', '\1\1', 'g'), '(?i)(?:^|[^\p{{L}}\p{{N}}])the(?:[^\p{{L}}\p{{N}}]|$)')) AS BIGINT) AS matches FROM documents")
def search_whole_word(spark, sf_dir):
    q = search.Query("the", whole_word=True)
    return docs(spark, sf_dir).select("doc_id", F.coalesce(search.count_matches(F.col("text"), q), F.lit(0)).cast("long").alias("matches"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def _lines(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1)


@query(
    f"""WITH {_LINES}, m AS (SELECT doc_id, line, unnest(regexp_extract_all(text, 'th[a-z]+n')) AS match FROM l),
k AS (SELECT doc_id, count(*) AS total FROM m GROUP BY doc_id), c AS (SELECT *, coalesce(sum(least(total, 500)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, CAST(least(total, 500, 10000 - before) AS BIGINT) AS shown, total FROM c WHERE before < 10000"""
)
def search_regex_capped(spark, sf_dir):
    found = search.positions(_lines(spark, sf_dir), search.Query("th[a-z]+n", is_regex=True, case_sensitive=True), "doc_id")
    kept = search.capped(found.withColumn("ord", F.col("doc_id")), "doc_id", "ord")
    return kept.groupBy("doc_id").agg(F.count("*").alias("shown"), F.max("total").alias("total"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3') AND source NOT IN ('src3') AND regexp_matches(text, '(?i)ther')")
def search_scope(spark, sf_dir):
    q = search.Query("ther", include=(" SRC1", "src2", "src3", ""), exclude=("src3",))
    rows = search.scoped(docs(spark, sf_dir).withColumn("author_slugs", F.array("source")), q)
    return rows.filter(F.col("text").rlike(search.pattern_of(q))).select("doc_id", "source")


@query(
    f"""WITH {_LINES}, t AS (SELECT doc_id, line, text, unnest(regexp_extract_all(text, 'th[a-z]+n')) AS match FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, match, count(*) AS n, line % 7 <> 0 AS fresh, CASE WHEN line % 7 <> 0 THEN '<' || match || '>' END AS replacement FROM t GROUP BY doc_id, line, match"""
)
def replace_plan(spark, sf_dir):
    """Matches found, then planned against lines of which every seventh has changed since."""
    q = search.Query("(th[a-z]+n)", is_regex=True, case_sensitive=True)
    lines = _lines(spark, sf_dir)
    now = lines.withColumn("text", F.when(F.col("line") % 7 == 0, F.upper("text")).otherwise(F.col("text")))
    plan = search.replace_plan(search.positions(lines, q, "doc_id"), now, q, "<$1>", "doc_id")
    return plan.groupBy("doc_id", "line", "match", "fresh", "replacement").agg(F.count("*").alias("n"))


def worded(texts: DataFrame, key: str) -> DataFrame:
    """key and the folded words of each text."""
    return texts.select(key, F.transform(w.tokens(F.col("text")), w.fold_token).alias("words"))


_GRAM = "lead(surface, {0}) OVER (PARTITION BY doc_id ORDER BY pos)"
_POS = f"p AS (SELECT doc_id, pos, {SURFACE_SQL} AS surface FROM (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}') AS a FROM documents)))"


@query(
    f"""WITH {_POS}, bp AS (SELECT item_id, pos, {SURFACE_SQL} AS surface FROM (SELECT item_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}') AS a FROM benchmark))),
ph AS (SELECT DISTINCT surface || ' ' || nxt AS phrase FROM (SELECT surface, lead(surface) OVER (PARTITION BY item_id ORDER BY pos) AS nxt, pos FROM bp) WHERE nxt IS NOT NULL),
g AS (SELECT doc_id, surface || ' ' || {_GRAM.format(1)} AS phrase FROM p)
SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS documents FROM g WHERE phrase IN (SELECT phrase FROM ph) GROUP BY phrase"""
)
def phrase_lexicon(spark, sf_dir):
    """Two-word phrases of the benchmark as they stand in documents."""
    bench = worded(table(spark, sf_dir, "benchmark"), "item_id")
    phrases = bench.select(F.inline(mining.word_runs(2))).filter("words = 2 and phrase is not null").select("phrase").distinct()
    runs = worded(docs(spark, sf_dir), "doc_id").select("doc_id", F.inline(mining.word_runs(2))).filter("words = 2 and phrase is not null")
    spans = runs.join(small(phrases), "phrase", "left_semi").select(F.col("doc_id").alias("path"), F.lit("phrase").alias("type"), "phrase")
    return mining.phrase_lexicon(spans).select("phrase", "n", F.col("files").alias("documents"))


@query(
    f"""WITH {_POS}, fr AS (SELECT surface, count(*) AS n FROM (WITH {_tok('lang')} SELECT * FROM tok) WHERE lang = 'fr' GROUP BY surface),
ot AS (SELECT surface, count(*) AS n FROM (WITH {_tok('lang')} SELECT * FROM tok) WHERE lang <> 'fr' GROUP BY surface),
lex AS (SELECT fr.surface, CASE WHEN coalesce(ot.n, 0) >= fr.n THEN 'weak' ELSE 'strong' END AS strength FROM fr LEFT JOIN ot USING (surface)),
h AS (SELECT p.doc_id, p.pos, p.surface, strength, p.pos - row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS island FROM p JOIN lex USING (surface)),
r AS (SELECT doc_id, min(pos) AS s, max(pos) AS e, count(*) AS n, max(CASE WHEN strength = 'strong' THEN length(surface) ELSE 0 END) AS longest FROM h GROUP BY doc_id, island)
SELECT doc_id, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS words FROM r WHERE longest > 0 AND (n > 1 OR longest >= 4) GROUP BY doc_id"""
)
def language_clusters(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("lang", F.when(F.col("lang") == "fr", F.col("lang")))
    lexicon = mining.language_lexicon(acc.surface_counts(rows, "lang").withColumnRenamed("surface", "word"))
    return mining.language_clusters(worded(rows, "doc_id"), lexicon, "doc_id").groupBy("doc_id").agg(F.count("*").alias("clusters"), F.sum("n").alias("words"))


@query(
    f"""WITH {_POS}, bp AS (SELECT item_id, pos, {SURFACE_SQL} AS surface FROM (SELECT item_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}') AS a FROM benchmark))),
h AS (SELECT surface AS a, lead(surface) OVER w AS b, lead(surface, 2) OVER w AS c FROM bp WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
ph AS (SELECT DISTINCT a || ' ' || b AS phrase FROM h WHERE b IS NOT NULL UNION SELECT DISTINCT a || ' ' || b || ' ' || c FROM h WHERE c IS NOT NULL),
g AS (SELECT doc_id, pos, surface || ' ' || lead(surface) OVER w AS two, surface || ' ' || lead(surface) OVER w || ' ' || lead(surface, 2) OVER w AS three FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, CASE WHEN three IN (SELECT phrase FROM ph) THEN 3 WHEN two IN (SELECT phrase FROM ph) THEN 2 END AS words FROM g),
k AS (SELECT doc_id, pos, words, max(pos + words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f WHERE words IS NOT NULL)
SELECT doc_id, count(*) AS fused, CAST(sum(words) AS BIGINT) AS words FROM k WHERE reach IS NULL OR pos + words > reach GROUP BY doc_id"""
)
def multiword_fusion(spark, sf_dir):
    runs = worded(table(spark, sf_dir, "benchmark"), "item_id").select(F.inline(mining.word_runs(3)))
    phrases = runs.filter("words > 1 and phrase is not null").select("phrase")
    found = mining.longest_phrases(worded(docs(spark, sf_dir), "doc_id"), phrases, "doc_id", 3)
    return found.groupBy("doc_id").agg(F.count("*").alias("fused"), F.sum("words").cast("long").alias("words"))


@query(r"SELECT page_id, CAST(len(regexp_extract_all(html, '<a [^>]*>')) AS BIGINT) AS exempt, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS plain_chars FROM pages")
def markup_exempt_split(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<a [^>]*>"), F.lit(0))).cast("long").alias("exempt"), F.char_length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("plain_chars"))


@query("SELECT conv_id, role AS speaker, count(*) AS blocks, CAST(min(turn) AS BIGINT) AS first_turn, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id, role")
def speaker_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("conv_id", F.col("role").alias("speaker")).agg(F.count("*").alias("blocks"), F.min("turn").alias("first_turn"), F.md5(joined).alias("digest"))


_SNAP = "CASE WHEN doc_id % 11 = 0 THEN md5(coalesce(text, '') || 'x') ELSE md5(coalesce(text, '')) END"


@query(
    f"""WITH a AS (SELECT doc_id, length(coalesce(text, '')) AS size, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 13 <> 0),
b AS (SELECT doc_id, length(coalesce(text, '')) AS size, {_SNAP} AS hash FROM documents WHERE doc_id % 17 <> 0)
SELECT doc_id, CASE WHEN b.hash IS NULL THEN 'new' WHEN a.hash IS NULL THEN 'removed' WHEN a.size <> b.size OR a.hash <> b.hash THEN 'changed' ELSE 'fresh' END AS state
FROM a FULL JOIN b USING (doc_id)"""
)
def freshness_sweep(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = docs(spark, sf_dir).select("doc_id", F.char_length(text).alias("size"), F.md5(text).alias("hash"), F.md5(F.concat(text, F.lit("x"))).alias("other"))
    before = rows.filter("doc_id % 17 <> 0").select("doc_id", "size", F.when(F.col("doc_id") % 11 == 0, F.col("other")).otherwise(F.col("hash")).alias("hash"))
    return incremental.sweep(rows.filter("doc_id % 13 <> 0"), before, "doc_id")


@query(f"WITH {_tok('source')} SELECT source, surface, count(*) AS n FROM tok GROUP BY source, surface")
def incremental_equals_batch(spark, sf_dir):
    """Counts kept up by source: state of half of the sources, the others recomputed as touched."""
    all_docs = docs(spark, sf_dir)
    compute = lambda d: acc.surface_counts(d, "source")
    touched = all_docs.select("source").distinct().filter(F.crc32(F.col("source").cast("binary")) % 2 == 0)
    state = compute(all_docs.join(small(touched), "source", "left_anti"))
    return incremental.recheck(state, touched, all_docs, compute, "source")


@query(f"WITH {_LINES}, t AS (SELECT doc_id, line, CASE WHEN t = 'I' THEN t ELSE lower(t) END AS surface FROM (SELECT doc_id, line, unnest(regexp_extract_all(text, '{TOKEN_SQL}')) AS t FROM l)) SELECT doc_id, surface, count(*) AS candidates, CAST(min(line) AS INTEGER) AS line FROM t WHERE NOT {MECHANICAL_SQL} GROUP BY doc_id, surface")
def document_surfaces(spark, sf_dir):
    return acc.document_surfaces(docs(spark, sf_dir), "doc_id")
