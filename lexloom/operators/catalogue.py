"""The catalogue: authors, works and editions, their links, order, composition and inherited metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import settled, small


def joint_authors(host: Column, declared: Column) -> Column:
    """Author slugs of a work: under a joint host the declared ones, else its parts; else the host first, then the rest."""
    none = F.array().cast("array<string>")
    named = F.coalesce(declared, none)
    return F.when(host.contains("-"), F.when(F.size(named) > 0, named).otherwise(F.split(host, "-"))).otherwise(F.concat(F.array(host), F.array_except(named, F.array(host))))


def register_authors(works: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """work_authors (work_key, ord, slug) and authors with those that only works name, marked synthesised."""
    links = works.select("work_key", F.posexplode("author_slugs").alias("ord", "slug"))
    named = links.select("slug").distinct().join(authors.select("slug"), "slug", "left_anti")
    made = named.select("slug", F.col("slug").alias("surname"), F.lit(True).alias("synthesised"))
    return links, authors.withColumn("synthesised", F.lit(False)).unionByName(made, allowMissingColumns=True)


def canonical_edition(works: DataFrame, editions: DataFrame) -> DataFrame:
    """Each work's canonical edition: the declared one where it exists, else the latest; and whether the two differ."""
    latest = editions.groupBy("work_key").agg(F.max("slug").alias("latest"))
    declared = editions.select("work_key", F.col("slug").alias("canonical_slug"), F.lit(True).alias("_found"))
    out = works.join(latest, "work_key", "left").join(declared, ["work_key", "canonical_slug"], "left")
    chosen = F.when(F.col("_found"), F.col("canonical_slug")).otherwise(F.col("latest"))
    return out.withColumn("canonical", chosen).withColumn("fell_back", F.col("_found").isNull() & F.col("canonical_slug").isNotNull()).drop("_found", "latest")


def first_published(works: DataFrame, editions: DataFrame) -> DataFrame:
    """work_key and the least year of its editions; null where none has one."""
    return works.select("work_key").join(editions.groupBy("work_key").agg(F.min(F.array_min("published")).alias("first_published")), "work_key", "left")


def author_first_published(work_authors: DataFrame, work_years: DataFrame) -> DataFrame:
    return work_authors.join(work_years, "work_key").groupBy("slug").agg(F.min("first_published").alias("first_published"))


def author_order(authors: DataFrame) -> DataFrame:
    """By first publication (none last), then surname as readers sort it, then slug."""
    return authors.orderBy(F.col("first_published").asc_nulls_last(), F.expr("surname collate UNICODE"), "slug")


def next_edition(editions: DataFrame) -> DataFrame:
    return editions.withColumn("next_slug", F.lead("slug").over(Window.partitionBy("work_key").orderBy("slug")))


def comparable_works(editions: DataFrame) -> DataFrame:
    return editions.groupBy("work_key").agg(F.count("*").alias("editions")).filter("editions >= 2")


def resolve_refs(refs: DataFrame, editions: DataFrame) -> DataFrame:
    """refs (host_key, ordinal, ref) with doc_key of the edition, case put aside; null where none."""
    ids = editions.select(F.lower("doc_id").alias("_ref"), "doc_key").dropDuplicates(["_ref"])
    return refs.withColumn("_ref", F.lower("ref")).join(ids, "_ref", "left").drop("_ref")


def compose(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All editions that each edition holds, directly (depth 2) or through others, and the references that lie on a cycle.

    refs has host_key and doc_key. Pairs of root and edition are kept once, at their least depth; a round joins the new
    pairs with the references, so rounds end with the deepest composition and a cycle adds no pairs twice.
    """
    edges = settled(refs.filter("doc_key is not null").select("host_key", "doc_key").distinct())
    held = last = edges.select(F.col("host_key").alias("root"), "doc_key", F.lit(2).alias("depth"))
    while True:
        step = last.select("root", F.col("doc_key").alias("host_key"), F.col("depth") + 1).join(edges, "host_key").select("root", "doc_key", F.col("(depth + 1)").alias("depth")).distinct()
        last = settled(step.join(held.select("root", "doc_key"), ["root", "doc_key"], "left_anti"))
        if last.isEmpty():
            break
        held = settled(held.unionByName(last))
    back = held.select(F.col("root").alias("doc_key"), F.col("doc_key").alias("host_key"))
    cycles = edges.join(back, ["host_key", "doc_key"], "left_semi").unionByName(edges.filter("host_key = doc_key")).distinct()
    return held.filter("root <> doc_key"), cycles


def inherited(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata of sections with the nearest ancestor's value for each key, within a file; sections has path, id, ancestors, metadata."""
    own = sections.select("path", F.col("id").alias("_a"), F.col("metadata").alias("_m"))
    chain = sections.select("path", "id", F.posexplode(F.concat("ancestors", F.array("id"))).alias("_level", "_a"))
    met = chain.join(own, ["path", "_a"])
    values = [F.max_by(F.try_element_at("_m", F.lit(k)), F.when(F.map_contains_key("_m", F.lit(k)), F.col("_level"))).alias(k) for k in keys]
    return met.groupBy("path", "id").agg(*values)


def merged_dictionary(sections: DataFrame) -> DataFrame:
    """Overrides that hold in each section: its own over its ancestors', key by key."""
    own = sections.select("path", F.col("id").alias("_a"), F.explode("dictionary").alias("surface", "value"))
    chain = sections.select("path", "id", F.posexplode(F.concat("ancestors", F.array("id"))).alias("_level", "_a"))
    return chain.join(own, ["path", "_a"]).groupBy("path", "id", "surface").agg(F.max_by("value", "_level").alias("value"))


def letter_groups(authors: DataFrame) -> DataFrame:
    """Authors under the first letter of surname, or of slug where that is empty, with how many a letter has: one row an author."""
    letter = F.upper(F.left(F.coalesce(F.nullif("surname", F.lit("")), F.col("slug")), F.lit(1)))
    rows = authors.select(letter.alias("letter"), "slug").distinct()
    return rows.join(small(rows.groupBy("letter").agg(F.count("*").alias("authors"))), "letter")


def each_once(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def work_order(works: DataFrame) -> DataFrame:
    """By first publication (none last), then slug."""
    return works.orderBy(F.col("first_published").asc_nulls_last(), "slug")


def edition_order(editions: DataFrame) -> DataFrame:
    """Editions of a work by slug, code point by code point."""
    return editions.withColumn("place", F.row_number().over(Window.partitionBy("work_key").orderBy("slug")))


def picker_order(authors: DataFrame) -> DataFrame:
    """slug and name of authors by surname and forename as readers sort them."""
    name = F.trim(F.concat("forename", F.lit(" "), "surname"))
    return authors.select("slug", name.alias("name"), "surname", "forename").orderBy(F.expr("surname collate UNICODE"), F.expr("forename collate UNICODE"), "slug").select("slug", "name")


def imported(works: DataFrame, editions: DataFrame, order: str = "imported") -> DataFrame:
    """work_key and whether its canonical edition is imported, once a work; works has canonical, editions slug and imported.
    Of editions with one slug the first by order counts."""
    chosen = editions.groupBy("work_key", F.col("slug").alias("canonical")).agg(F.min_by("imported", order).alias("imported"))
    return works.select("work_key", "canonical").join(chosen, ["work_key", "canonical"], "left").select("work_key", "imported")


def listed(works: DataFrame) -> DataFrame:
    """Works that stand by themselves: not those kept for collections alone."""
    return works.filter(F.coalesce("standalone", F.lit(True)))


def borrowable(editions: DataFrame) -> DataFrame:
    """id and title of every edition, once; editions of one key but different titles stay apart."""
    return editions.select("doc_key", F.col("doc_id").alias("id"), "title").distinct().select("id", "title")


def borrowed_children(refs: DataFrame, editions: DataFrame) -> DataFrame:
    """refs (host_key, doc_key) whose child is an edition, with its work and slug."""
    return refs.join(editions.select("doc_key", "work_key", "slug"), "doc_key").select("host_key", "doc_key", "work_key", "slug")


def labelled_changes(changes: DataFrame, labels: DataFrame, key: str = "path") -> DataFrame:
    """changes (path, change) with the edition's label, or the path where there is none; key names an edition in both."""
    return changes.join(labels.select(key, "label"), key, "left").select("path", F.coalesce("label", "path").alias("label"), "change")


def tree_counts(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """path with how many sections are below its root and how many blocks it has in all."""
    inner = sections.groupBy("path").agg(F.count(F.when(F.col("depth") > 1, 1)).alias("sections"))
    return inner.join(blocks.groupBy("path").agg(F.count("*").alias("blocks")), "path", "left").select("path", "sections", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def build_summary(**tables: DataFrame) -> DataFrame:
    """One row for each table: its name and number of rows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
