"""Queries over the relational and event tables, each with SQL for the same rows.

region, nation, customer, orders and lineitem stand for authors, works, editions and
sections; parts and suppliers for joint authorship; events for a change log.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.operators import catalogue, rules
from lexloom.plans.collection_queries import QUERIES as _COLLECTION
from lexloom.plans.editor_queries import QUERIES as _EDITOR
from lexloom.plans.register_queries import QUERIES as _REGISTER
from lexloom.plans.text_queries import QUERIES as _TEXT
from lexloom.plans.text_queries import table
from lexloom.session import small
from lexloom.streaming import incremental

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def _editions(spark, sf_dir):
    """Orders as editions: the customer is the work, the order's key the slug, its year the year of publication."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").alias("work_key"), F.col("o_orderkey").alias("slug"), F.array(F.year("o_orderdate")).alias("published"), "o_orderstatus")


@query("SELECT c_custkey AS work_key, CAST(min(year(o_orderdate)) AS INTEGER) AS first_published FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def work_first_published(spark, sf_dir):
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work_key"))
    return catalogue.first_published(works, _editions(spark, sf_dir))


@query(
    """SELECT n_name AS surname, CAST(n_nationkey AS INTEGER) AS slug, CAST(min(year(o_orderdate)) AS INTEGER) AS first_published
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name, n_nationkey"""
)
def author_order(spark, sf_dir):
    links = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work_key"), F.col("c_nationkey").alias("slug"))
    years = catalogue.author_first_published(links, catalogue.first_published(links.select("work_key"), _editions(spark, sf_dir)))
    authors = small(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("slug"), F.col("n_name").alias("surname"))).join(years, "slug", "left")
    return catalogue.author_order(authors).select("surname", F.col("slug").cast("int").alias("slug"), "first_published")


@query(
    """WITH l AS (SELECT o_custkey AS work_key, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey)
SELECT c_custkey AS work_key, coalesce(d.o_orderkey, l.latest) AS canonical, d.o_orderkey IS NULL AS fell_back
FROM customer LEFT JOIN l ON l.work_key = c_custkey LEFT JOIN orders d ON d.o_custkey = c_custkey AND d.o_orderkey = c_custkey * 7 + 1"""
)
def canonical_edition(spark, sf_dir):
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work_key"), (F.col("c_custkey") * 7 + 1).alias("canonical_slug"))
    return catalogue.canonical_edition(works, _editions(spark, sf_dir)).select("work_key", "canonical", "fell_back")


@query("SELECT o_custkey AS work_key, o_orderkey AS slug, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_slug FROM orders")
def next_edition(spark, sf_dir):
    return catalogue.next_edition(_editions(spark, sf_dir)).select("work_key", "slug", "next_slug")


@query("SELECT o_custkey AS work_key, count(*) AS editions FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def comparable_works(spark, sf_dir):
    return catalogue.comparable_works(_editions(spark, sf_dir))


@query(
    """WITH k AS (SELECT DISTINCT l_partkey AS work_key, l_suppkey AS s FROM lineitem)
SELECT k.work_key, 's' || k.s AS slug, CASE WHEN k.s >= 5 THEN s_name ELSE 's' || k.s END AS surname, k.s < 5 AS synthesised FROM k LEFT JOIN supplier ON s_suppkey = k.s"""
)
def joint_authorship(spark, sf_dir):
    """Parts as works of several suppliers; the first five suppliers have no file, so their names are made from the slugs."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("work_key"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("slug")).distinct()
    declared = links.groupBy("work_key").agg(F.array_sort(F.collect_set("slug")).alias("declared"))
    works = declared.select("work_key", catalogue.joint_authors(F.col("declared")[0], F.col("declared")).alias("author_slugs"))
    authors = table(spark, sf_dir, "supplier").filter("s_suppkey >= 5").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_name").alias("surname"))
    named, known = catalogue.register_authors(works, authors)
    return named.join(small(known), "slug").select("work_key", "slug", "surname", "synthesised")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def unresolved_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("PART."), F.col("l_partkey").cast("string")).alias("ref"))
    held = table(spark, sf_dir, "part").filter("p_size > 5").select(F.concat(F.lit("Part."), F.col("p_partkey").cast("string")).alias("doc_id"), F.col("p_partkey").alias("doc_key"))
    return catalogue.resolve_refs(refs, held).filter("doc_key is null").select("l_orderkey", "l_linenumber", "l_partkey")


_BORROWED = """e AS (SELECT DISTINCT conv_id AS host, conv_id + turn + 1 AS child FROM conversations WHERE turn < 2 AND conv_id % 7 + turn + 1 < 7),
ok AS (SELECT host, child FROM e WHERE child IN (SELECT conv_id FROM conversations))"""


def _borrowed(spark, sf_dir):
    """Conversations hold the next one and the one after it, within each seven: compositions end there."""
    rows = table(spark, sf_dir, "conversations")
    held = rows.select(F.col("conv_id").alias("doc_key")).distinct()
    inside = rows.filter("turn < 2 and conv_id % 7 + turn + 1 < 7").select(F.col("conv_id").alias("host_key"), (F.col("conv_id") + F.col("turn") + 1).alias("doc_key"))
    return inside.distinct().join(held, "doc_key", "left_semi")


@query(
    f"""WITH RECURSIVE {_BORROWED}, r AS (SELECT host AS root, child, 2 AS depth FROM ok UNION SELECT r.root, ok.child, r.depth + 1 FROM r JOIN ok ON ok.host = r.child)
SELECT root, child AS doc_key, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY root, child"""
)
def compose_tree(spark, sf_dir):
    return catalogue.compose(_borrowed(spark, sf_dir))[0].select("root", "doc_key", "depth")


@query("SELECT c_custkey AS host_key, CASE WHEN c_custkey % 4 = 2 THEN c_custkey - 2 ELSE c_custkey + 1 END AS doc_key FROM customer WHERE c_custkey % 4 < 3 AND c_custkey - c_custkey % 4 + 2 IN (SELECT c_custkey FROM customer)")
def composition_cycles(spark, sf_dir):
    """References that lie on a cycle: of each four works the first three hold each other in a ring, and the last holds the first."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host_key"))
    child = F.expr("case host_key % 4 when 2 then host_key - 2 when 3 then host_key - 3 else host_key + 1 end")
    return catalogue.compose(rows.select("host_key", child.alias("doc_key")))[1]


@query(
    """WITH m AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN role || ':' || length(text) END AS own FROM conversations)
SELECT conv_id, turn, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM m"""
)
def cascade_metadata(spark, sf_dir):
    """Turns as sections, each inside the ones before it; a section's value is its own or the nearest ancestor's."""
    own = F.when(F.char_length("text") % 3 == 0, F.create_map(F.lit("own"), F.concat("role", F.lit(":"), F.char_length("text").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("id"), own.alias("metadata"))
    return catalogue.inherited(_inside(rows), ["own"]).select(F.col("path").alias("conv_id"), F.col("id").alias("turn"), F.col("own").alias("value"))


def _inside(rows):
    before = Window.partitionBy("path").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ancestors", F.collect_list("id").over(before))


@query(
    """SELECT c.conv_id, c.turn, t.role AS surface, max(t.turn) AS value FROM conversations c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn <= c.turn GROUP BY c.conv_id, c.turn, t.role"""
)
def merged_overrides(spark, sf_dir):
    """Overrides that hold in each turn, its own over those of the turns around it."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("id"), F.create_map("role", "turn").alias("dictionary"))
    return catalogue.merged_dictionary(_inside(rows)).select(F.col("path").alias("conv_id"), F.col("id").alias("turn"), "surface", "value")


_SCHEMA_SQL = """SELECT c_custkey AS record, 'missing "surname"' AS message FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, '"birth" should be number' FROM customer WHERE c_nationkey % 5 = 0
UNION ALL SELECT c_custkey, 'unknown key "nickname"' FROM customer WHERE c_custkey % 9 = 0
UNION ALL SELECT c_custkey, '"viaf" should be a VIAF cluster ID (digits)' FROM customer WHERE c_custkey % 4 = 0"""


@query(_SCHEMA_SQL)
def schema_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    metadata = F.map_filter(
        F.create_map(
            F.lit("forename"), text(F.col("c_name")), F.lit("surname"), F.when(F.col("c_mktsegment") != "BUILDING", text(F.col("c_mktsegment"))),
            F.lit("birth"), F.when(F.col("c_nationkey") % 5 == 0, F.lit('"long ago"')).otherwise(F.lit("1700")), F.lit("death"), F.lit("1776"), F.lit("nationality"), F.lit('"Scottish"'), F.lit("sex"), F.lit('"Male"'),
            F.lit("nickname"), F.when(F.col("c_custkey") % 9 == 0, F.lit('"Nick"')), F.lit("viaf"), F.when(F.col("c_custkey") % 4 == 0, F.lit('"0x"')).otherwise(F.lit('"17"')),
        ),
        lambda k, v: v.isNotNull(),
    )
    records = rows.select(F.col("c_custkey").alias("record"), metadata.alias("metadata"))
    return rules.record_violations(records, "record", rules.AUTHOR).select("record", "message")


@query("SELECT p_partkey AS record, '\"brand\" should be ' || 'Brand#' || ' + two digits' AS message FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3]\\d')")
def identifier_violations(spark, sf_dir):
    form = rules.Schema({"brand": "string"}, (), {"brand": (r"^Brand#[1-3]\d$", "Brand# + two digits")})
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record"), F.create_map(F.lit("brand"), F.concat(F.lit('"'), "p_brand", F.lit('"'))).alias("metadata"))
    return rules.record_violations(records, "record", form).select("record", "message")


@query(f"WITH v AS ({_SCHEMA_SQL}) SELECT record, count(*) AS total, string_agg(message, '; ' ORDER BY message) AS messages FROM v GROUP BY record")
def violations_by_file(spark, sf_dir):
    rows = schema_violations(spark, sf_dir)
    return rows.groupBy("record").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("messages"))


@query(
    """SELECT user_id, event_type, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS refs FROM events GROUP BY user_id, event_type
HAVING sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) > 0"""
)
def refcount_fold(spark, sf_dir):
    changes = table(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1))
    return incremental.refcounts(changes, ["user_id", "event_type"])


@query("SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def latest_change_per_path(spark, sf_dir):
    return incremental.latest_changes(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, session"""
)
def change_sessions(spark, sf_dir):
    return incremental.quiet_sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 3600)


@query(
    """WITH l AS (SELECT upper(left(CASE WHEN s_suppkey % 5 = 0 THEN 's' || s_suppkey ELSE chr(CAST(97 + s_suppkey % 26 AS INTEGER)) || s_name END, 1)) AS letter, 's' || s_suppkey AS slug FROM supplier)
SELECT letter, slug, count(*) OVER (PARTITION BY letter) AS authors FROM l"""
)
def letter_groups(spark, sf_dir):
    surname = F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.concat(F.chr(F.col("s_suppkey") % 26 + 97), "s_name"))
    return catalogue.letter_groups(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"), surname.alias("surname"))).select("letter", "slug", "authors")


@query(
    """SELECT r_name, n_name, count(DISTINCT c_custkey) AS works, count(o_orderkey) AS editions FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name"""
)
def browse_tree(spark, sf_dir):
    per_work = _editions(spark, sf_dir).groupBy("work_key").agg(F.count("*").alias("k"))
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work_key"), "c_nationkey").join(per_work, "work_key", "left")
    per_nation = works.groupBy("c_nationkey").agg(F.count("*").alias("works"), F.coalesce(F.sum("k"), F.lit(0)).alias("editions"))
    nations = small(table(spark, sf_dir, "nation")).join(small(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return per_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "works", "editions")


@query(
    """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'signedOut' WHEN o_orderstatus = 'O' THEN CASE WHEN o_custkey % 3 = 0 THEN 'clean' ELSE 'editing' END
  WHEN o_orderkey % 4 = 0 THEN 'unfinished' WHEN o_orderkey % 4 = 1 THEN 'sent' ELSE 'decided' END AS state, count(*) AS n FROM orders GROUP BY 1"""
)
def submission_states(spark, sf_dir):
    pull = F.when(F.col("o_orderkey") % 4 == 1, "open").when(F.col("o_orderkey") % 4 > 1, "closed")
    state = incremental.submission_state(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") != "O", F.col("o_custkey") % 3, pull)
    return table(spark, sf_dir, "orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


ALL = _TEXT | QUERIES | _COLLECTION | _REGISTER | _EDITOR
