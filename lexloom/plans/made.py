"""A collection of marked-up sources made from the driver's tables, with faults of every kind, and the same facts as SQL.

Nations are authors, customers works with a stub each, orders editions. Keys decide what each source
holds and what is wrong with it; MADE_SQL says so once more for DuckDB, from the keys alone, without any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources import marked

#: a: authors; w: works; e: editions with the lines where their parts begin.
MADE_SQL = r"""a AS (SELECT n_nationkey AS n, 'authors/a' || n_nationkey || '.mit' AS path FROM nation),
w AS (SELECT c, n, c_name, seg, host, 'works/' || host || '/w' || c AS dir, 'works/' || host || '/w' || c || '/index.mit' AS path, upper(host) || CASE WHEN c % 8 = 1 THEN '.V' ELSE '.W' END || c AS id,
             c % 21 <> 20 AS has_stub, c % 5 <> 0 AS has_canonical, c % 6 = 5 AS collected
      FROM (SELECT c_custkey AS c, c_nationkey AS n, c_name, c_mktsegment AS seg,
                   CASE WHEN c_custkey % 50 = 7 THEN 'B' || c_nationkey WHEN c_custkey % 10 = 0 THEN 'a' || c_nationkey || '-a' || ((c_nationkey + 1) % 27) ELSE 'a' || c_nationkey END AS host FROM customer)),
e0 AS (SELECT o_orderkey AS k, o_custkey AS c, w.n, w.host, w.dir, year(o_orderdate) AS y, o_orderpriority AS crumb, o_orderstatus AS status,
              year(o_orderdate) || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || chr(CAST(97 + (o_orderkey // 10000) % 26 AS INTEGER)) AS slug,
              5 - (CASE WHEN o_orderkey % 7 = 2 THEN 1 ELSE 0 END) - (CASE WHEN o_orderkey % 6 = 1 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 17 = 3 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 31 = 8 THEN 1 ELSE 0 END) AS m
       FROM orders JOIN w ON w.c = o_custkey),
e1 AS (SELECT *, dir || '/' || slug || '.mit' AS path, upper(host) || '.W' || c || '.' || slug AS id, k % 31 <> 8 AS clean, m + 5 AS l1, k % 19 = 4 AS nested, k % 10 = 5 AS borrows FROM e0),
e AS (SELECT e1.*, e1.id || '.1' AS sid, e1.l1 + 9 AS l2, e1.l1 + CASE WHEN e1.nested THEN 15 ELSE 9 END AS l3, CASE WHEN e1.borrows THEN CASE WHEN e1.k % 20 = 5 AND x.id IS NOT NULL THEN x.id ELSE 'A0.W0.1600' END END AS ref,
             e1.borrows AND e1.k % 20 = 5 AND x.id IS NOT NULL AS resolves, x.path AS ref_path FROM e1 LEFT JOIN e1 x ON x.k = e1.k + 1)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(*parts) -> F.Column:
    """Lines joined by newlines; a null part is no line."""
    return F.concat(F.array_join(F.array(*[p if not isinstance(p, str) else F.lit(p) for p in parts]), "\n"), F.lit("\n"))


def author_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    text = _lines(
        F.format_string("# A%d", "n"), "", "[metadata]", F.format_string('forename = "F%d"', "n"), F.when(F.expr("n % 7 <> 3"), F.format_string('surname = "N%d"', "n")),
        F.when(F.expr("n % 5 = 4"), 'birth = "long ago"').otherwise(F.format_string("birth = %d", F.col("n") + 1700)), F.format_string("death = %d", F.col("n") + 1760),
        F.format_string('nationality = "R%d"', "r"), F.when(F.expr("n % 6 = 5"), 'sex = "X"').otherwise('sex = "Male"'), F.when(F.expr("n % 4 = 1"), 'viaf = "0x"'),
        F.when(F.expr("n % 8 = 6"), F.lit("\n## Extra")), F.when(F.expr("n % 9 = 7"), F.lit("\n{#1}\nSome words.")),
    )
    return rows.select(F.format_string("authors/a%d.mit", "n").alias("path"), text.alias("text"))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"), "c_name", F.col("c_mktsegment").alias("seg"))
    host = F.when(F.expr("c % 50 = 7"), F.format_string("B%d", "n")).when(F.expr("c % 10 = 0"), F.format_string("a%d-a%d", F.col("n"), F.expr("(n + 1) % 27"))).otherwise(F.format_string("a%d", "n"))
    out = rows.withColumn("host", host).withColumn("dir", F.format_string("works/%s/w%d", "host", "c"))
    return out.withColumn("id", F.concat(F.upper("host"), F.when(F.expr("c % 8 = 1"), ".V").otherwise(".W"), F.col("c").cast("string")))


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, c, host, y, slug, path and id of each edition."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("crumb"), F.col("o_orderstatus").alias("status"))
    slug = F.concat(F.format_string("%d-%04d", F.col("y"), F.expr("k % 10000")), F.chr(F.expr("97 + (k div 10000) % 26")))
    out = rows.join(works(spark, sf_dir).select("c", "n", "host", "dir"), "c").withColumn("slug", slug)
    return out.withColumn("path", F.format_string("%s/%s.mit", "dir", "slug")).withColumn("id", F.concat(F.upper("host"), F.format_string(".W%d.%s", "c", "slug")))


def stub_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = works(spark, sf_dir).join(editions(spark, sf_dir).groupBy("c").agg(F.max("slug").alias("latest")), "c", "left").filter("c % 21 <> 20")
    author = F.when(F.expr("c % 9 = 0"), F.lit('authors = ["zz"]')).when(F.expr("c % 4 <> 0"), F.format_string('authors = ["a%d"]', "n"))
    text = _lines(
        F.concat(F.lit("# "), "id"), "", "[metadata]", F.format_string('title = "%s"', "c_name"), F.format_string('breadcrumb = "%s"', "seg"), author,
        F.concat(F.lit('canonical = "'), F.when(F.expr("c % 5 = 0"), "1700").otherwise(F.coalesce("latest", F.lit("1700"))), F.lit('"')),
        F.when(F.expr("c % 6 = 5"), "standalone = false"), F.when(F.expr("c % 11 = 0"), "published = [1999]"), F.when(F.expr("c % 13 = 0"), F.lit("\n{#1}\nA body.")),
    )
    return rows.select(F.concat("dir", F.lit("/index.mit")).alias("path"), text.alias("text"))


def edition_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, path and text of each edition."""
    rows = editions(spark, sf_dir)
    follow = rows.select((F.col("k") - 1).alias("k"), F.col("id").alias("next_id"))
    rows = rows.join(follow, "k", "left")
    on = lambda test, *parts: [F.when(F.expr(test), p if not isinstance(p, str) else F.lit(p)) for p in parts]
    tag = F.concat(F.lit('{#1, pages="'), F.expr("cast(k % 100 as string)"), F.lit('"'), F.when(F.expr("k % 23 = 6"), F.lit(', mood="x"')).otherwise(""), F.when(F.expr("k % 29 = 7"), F.lit(', authors=["yy"]')).otherwise(""), F.lit("}"))
    body = F.concat(F.lit("The [p:Ada] saw $fr:le roi$ and [w:was=be] "), "status", F.col("k").cast("string"), F.lit(" [-old-][+new+] of[l: Rome] end."))
    ref = F.concat(F.lit("## <"), F.when(F.expr("k % 20 = 5"), F.coalesce("next_id", F.lit("A0.W0.1600"))).otherwise("A0.W0.1600"), F.lit(">"))
    text = _lines(
        F.concat(F.lit("# "), "id"), "", "[metadata]", F.format_string('title = "T%d"', "k"), *on("k % 7 <> 2", F.format_string('breadcrumb = "%s"', "crumb")), F.format_string('authors = ["a%d"]', "n"),
        *on("k % 6 <> 1", F.concat(F.lit("imported = "), F.expr("cast(status = 'F' as string)"))), F.format_string("published = [%d]", "y"), *on("k % 17 = 3", "standalone = true"), *on("k % 31 = 8", "nonsense"),
        "", "## 1", "", "[metadata]", 'title = "One"', 'breadcrumb = "1"', "", tag, body, "",
        *on("k % 19 = 4", "### x.y", "", "[metadata]", 'title = "Inner"', 'breadcrumb = "i"', ""), F.when(F.expr("k % 10 = 5"), ref),
    )
    return rows.select("k", "path", text.alias("text"))


def edition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edition_sources(spark, sf_dir).select("path", "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_files(spark, sf_dir).unionByName(stub_files(spark, sf_dir)).unionByName(edition_files(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str, *kinds) -> DataFrame:
    """The parsed sources of the given kinds, or of all."""
    made = None
    for kind in kinds or (files,):
        made = kind(spark, sf_dir) if made is None else made.unionByName(kind(spark, sf_dir))
    return marked.parse_files(made)
