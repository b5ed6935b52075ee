"""Words: tokens of plain text, folding, possessives, numerals, shards."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: a token is letters, digits and apostrophes with a letter or digit; a period joins before a letter.
TOKEN = r"(?:['’]*[\p{L}\p{N}])+(?:\.\p{L}(?:['’]*[\p{L}\p{N}])*)*['’]*"
#: A word of the register (several by single spaces), a Roman numeral, and the frames that take a token out of the account.
WORD = r"^['’]*\p{L}(?:['’\p{L}]|\.(?=\p{L}))*(?: ['’]*\p{L}(?:['’\p{L}]|\.(?=\p{L}))*)*$"
ROMAN = r"^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
EXEMPTING = ("person", "place", "org", "citation", "language")


def tokens(text: Column) -> Column:
    """All tokens of a text in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case word by word, but for the bare word I."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(w == "I", w).otherwise(F.lower(w))), " ")


def fold_token(token: Column) -> Column:
    """fold for a text that holds no space."""
    return F.when(token == "I", token).otherwise(F.lower(token))


def possessive_base(surface: Column) -> Column:
    """The surface without a closing 's, null where there is none or nothing before it."""
    return F.nullif(F.regexp_extract(surface, "^(.+)['’]s$", 1), F.lit(""))


def is_word(text: Column) -> Column:
    return text.rlike(WORD)


def is_roman(token: Column) -> Column:
    return (token != "") & F.lower(token).rlike(ROMAN)


def is_mechanical(token: Column) -> Column:
    """Holds a digit or is a Roman numeral."""
    return token.rlike(r"\p{N}") | is_roman(token)


def letter_of(surface: Column) -> Column:
    first = F.lower(F.regexp_extract(surface, r"\p{L}", 0))
    return F.when(first.between("a", "z"), first).otherwise("other")


def shard_of(surface: Column) -> Column:
    return F.concat(letter_of(surface), F.lit(".json"))


def exemption_of(context: Column) -> Column:
    """The innermost frame type among those that take a token out of the account; context is array<struct<type>>."""
    return F.try_element_at(F.filter(context, lambda f: f["type"].isin(*EXEMPTING)), F.lit(-1))["type"]


def entry_words(text: Column) -> Column:
    """Folded words of an input, empty unless all are words."""
    words = F.transform(F.split(F.trim(text), r"\s+"), fold)
    return F.when(F.forall(words, is_word), words).otherwise(F.array().cast("array<string>"))


def reading_spelling(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["spelling"]), " ")


def reading_lemma(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["lemma"]), " ")


def _fold_lexical(text: str | None) -> str | None:
    if text is None:
        return None
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not "̀" <= c <= "ͯ")
    return bare.replace("æ", "ae").replace("œ", "oe").replace("’", "'").strip("'-")


@F.pandas_udf(StringType())
def fold_lexical(text: pd.Series) -> pd.Series:
    """Fold for lexicons: no accents or ligatures, straight apostrophes, none at the ends. Spark has no normalize()."""
    return text.map(_fold_lexical, na_action="ignore")


@F.pandas_udf(StringType())
def slugify(title: pd.Series) -> pd.Series:
    """Lower-case ASCII words joined by hyphens, as many whole words as 30 characters hold."""

    def one(text: str) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ").lower()
        out = ""
        for word in filter(None, "".join(c if c.isascii() and c.isalnum() else " " for c in bare).split(" ")):
            longer = f"{out}-{word}" if out else word
            if len(longer) > 30:
                break
            out = longer
        return out

    return title.map(one, na_action="ignore")
