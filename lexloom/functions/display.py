"""Texts for people: life spans, labels, links, coverage lines, templates, mark-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: authorities' names and where their records are.
AUTHORITIES = {
    "viaf": ("VIAF", "https://viaf.org/viaf/"),
    "wikidata": ("Wikidata", "https://www.wikidata.org/wiki/"),
    "estc": ("ESTC", "https://datb.cerl.org/estc/"),
    "tcp": ("TCP text", "https://github.com/textcreationpartnership/"),
}
MARKS = {"person": ("[p:", "]"), "place": ("[l:", "]"), "org": ("[o:", "]"), "citation": ("[", "]")}


def lifespan(birth: Column, death: Column) -> Column:
    shown = F.concat(F.lit("("), F.coalesce(birth.cast("string"), F.lit("?")), F.lit("–"), F.coalesce(death.cast("string"), F.lit("?")), F.lit(")"))
    return F.when(birth.isNull() & death.isNull(), "").otherwise(shown)


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def work_doc_id(edition_id: Column, host: Column, work: Column) -> Column:
    """An edition's id without its last segment, else Host.WORK."""
    return F.when(edition_id.contains("."), F.regexp_replace(edition_id, r"\.[^.]*$", "")).otherwise(F.concat(capitalize(host), F.lit("."), F.upper(work)))


def authority_links(**ids: Column) -> Column:
    """array<struct<kind, id, label, url>> of the authorities whose id is given and not empty, in the order given."""
    links = [F.struct(F.lit(k).alias("kind"), v.alias("id"), F.lit(AUTHORITIES[k][0]).alias("label"), F.concat(F.lit(AUTHORITIES[k][1]), v).alias("url")) for k, v in ids.items()]
    return F.filter(F.array(*links), lambda x: x["id"].isNotNull() & (x["id"] != ""))


def coverage_line(accounted: Column, total: Column) -> Column:
    share = F.format_string("%.1f%% of %d tokens accounted", 100 * accounted / total, total)
    return F.when(total == 0, "no tokens").otherwise(share)


def violation_text(path: Column, locus: Column, line: Column, col: Column, message: Column) -> Column:
    placed = F.format_string("%s:%d:%d: %s", path, line, F.coalesce(col, F.lit(1)), message)
    return F.when(line.isNotNull(), placed).when(locus.isNotNull(), F.concat(path, F.lit(" ("), locus, F.lit("): "), message)).otherwise(F.concat(path, F.lit(": "), message))


def edition_label(surnames: Column, breadcrumb: Column, slug: Column) -> Column:
    return F.concat_ws(" · ", F.array_join(surnames, " & "), breadcrumb, slug)


def word_markup(surface: Column, value: Column) -> Column:
    r"""[w:surface=value] with \, = and ] escaped."""
    escape = lambda c: F.regexp_replace(c, r"([\\=\]])", r"\\$1")
    return F.concat(F.lit("[w:"), escape(F.replace(surface, F.lit(" "), F.lit("~"))), F.lit("="), escape(F.replace(value, F.lit(" "), F.lit("~"))), F.lit("]"))


def wrap_text(text: Column, kind: str, code: str | None = None) -> Column:
    if kind == "language":
        return F.concat(F.lit(f"${code}:" if code else "$"), text, F.lit("$"))
    before, after = MARKS[kind]
    return F.concat(F.lit(before), text, F.lit(after))


def edition_template(doc_id: Column, title: Column, breadcrumb: Column, published: Column) -> Column:
    return F.format_string('# %s\n\n[metadata]\ntitle = "%s"\nbreadcrumb = "%s"\nimported = false\npublished = [%s]\n', doc_id, title, breadcrumb, F.array_join(published.cast("array<string>"), ", "))
