"""Title, name and genre normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of a normalised title, at any position.
ARTICLES = ["the", "a", "an", "el", "la", "le", "les", "der", "die", "das"]

# Every character that counts as white space when a value is stripped.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_NOT_SPACE = f"[^{WHITESPACE}]"
USABLE_ID = rf"^(?!(?:\\N|nan|[{WHITESPACE}]*(?:<NA>)?[{WHITESPACE}]*)\z)"
_LIST_SEPARATORS = r"[|;,]"
_NOT_WORD = r"[^\p{L}\p{N}_]+"


def _jvm_safe_class(limit: int = 0x250) -> str:
    """Regex class of the Latin characters that ``lower`` alone folds correctly.

    A character qualifies when compatibility normalisation leaves it alone and
    its case folding is its lower case. ``ß`` is folded by a ``replace``.
    """

    def safe(code: int) -> bool:
        char = chr(code)
        return char == "ß" or (
            unicodedata.normalize("NFKC", char) == char and char.casefold() == char.lower()
        )

    ranges: list[list[int]] = []
    for code in filter(safe, range(limit)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)


# The first range turns most characters away before the long list is looked at.
_NEEDS_FULL_FOLDING = f"[\\x{{80}}-\\x{{10ffff}}&&[^{_jvm_safe_class()}]]"


def strip(value: Column) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def has_text(value: Column) -> Column:
    """Whether a value has any character that is not white space."""
    return value.rlike(_NOT_SPACE)


def blank_to_null(value: Column) -> Column:
    return F.when(has_text(value), value)


def folded_words(value: Column) -> Column:
    """The words of a text after NFKC and case folding.

    Spark has no NFKC function. Latin text needs none, so it stays in the JVM;
    all other values take one Arrow batch function, which sees nulls elsewhere.
    """

    # A local function travels by value, so workers need not have this package.
    @F.pandas_udf("string")
    def full(values: pd.Series) -> pd.Series:
        folded = values.map(lambda text: unicodedata.normalize("NFKC", text).casefold(), na_action="ignore")
        return folded.str.replace(r"\W+", " ", regex=True)

    # Plain ASCII is told by its byte length alone.
    rare = (F.length(value) != F.octet_length(value)) & value.rlike(_NEEDS_FULL_FOLDING)
    latin = F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))
    return F.when(rare, F.split(full(F.when(rare, value)), " ")).otherwise(F.split(latin, _NOT_WORD))


def normalize_title(value: Column) -> Column:
    """Matching form of a title: folded words without punctuation and articles.

    Null gives the blank string.
    """
    words = folded_words(value.cast("string"))
    kept = F.filter(words, lambda word: ~word.isin("", *ARTICLES))
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def _list_items(value: Column) -> Column:
    items = F.transform(F.split(value.cast("string"), _LIST_SEPARATORS), strip)
    return F.filter(items, lambda item: (item != "") & (item != F.lit(r"\N")))


def normalize_name_list(value: Column, limit: int = 5) -> Column:
    """First ``limit`` names of a ``,``/``;``/``|`` list, joined by ``", "``."""
    return F.coalesce(F.array_join(F.slice(_list_items(value), 1, limit), ", "), F.lit(""))


def title_case(value: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    return F.array_join(F.transform(F.split(value, r"(?<=\P{L})"), F.initcap), "")


def normalize_genres(value: Column) -> Column:
    """Title-cased genres in first-seen order without repeats, joined by ``","``."""
    genres = F.array_distinct(F.transform(_list_items(value), title_case))
    return F.coalesce(F.array_join(genres, ","), F.lit(""))


def match_key(title_norm: Column, year: Column) -> Column:
    """``title|year``, with a blank for whichever is missing."""
    return F.concat_ws(
        "|",
        F.coalesce(title_norm, F.lit("")),
        F.coalesce(year.cast("int").cast("string"), F.lit("")),
    )


def has_id(imdb_id: Column) -> Column:
    """Whether a film id is usable: not blank and no null marker; never null."""
    return F.coalesce(imdb_id.rlike(USABLE_ID), F.lit(False))


def dedup_key(imdb_id: Column, title_norm: Column, year: Column) -> Column:
    """The film id where there is one, else the title key."""
    return F.when(has_id(imdb_id), imdb_id).otherwise(match_key(title_norm, year))
