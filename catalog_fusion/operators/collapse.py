"""Collapse of rows that describe one film, and the two-stage resolution.

Everything is one declarative aggregate per stage. Each task first combines its
own rows, so a key that holds a third of the table crosses the shuffle as one
small row per task, and no group is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_fusion.functions.parse import is_empty
from catalog_fusion.functions.text import match_key
from catalog_fusion.operators.conform import SOURCE_RANK
from catalog_fusion.schema import UNIFIED_COLUMNS
from catalog_fusion.scratch import materialize

# Filled from the best-ranked row that has a value. The normalised title
# belongs to the title and travels with it.
FIELDS = [
    "imdb_id",
    "title",
    "year",
    "release_date",
    "release_hour",
    "runtime_min",
    "budget_usd",
    "genres",
    "director",
    "cast",
    "language",
    "country",
]

# Stands in for a null tie break, so that nulls rank last.
_LAST = {"imdb_id": "\U0010ffff", SOURCE_RANK: 2**31 - 1, "release_date": date(9999, 12, 31)}


def _row_order(tie_breaks: Sequence[str]) -> Column:
    """Total order of rows: votes descending with nulls last, then the tie breaks.

    The closing hash separates rows that differ in any field, so the outcome
    does not depend on how Spark splits the input.
    """
    votes = F.coalesce(-F.col("vote_count"), F.lit(1)).alias("votes")
    ties = [F.coalesce(F.col(c), F.lit(_LAST[c])).alias(c) for c in tie_breaks]
    content = F.xxhash64(*[F.col(f"`{c}`") for c in UNIFIED_COLUMNS]).alias("content")
    return F.struct(votes, *ties, content)


def collapse(
    df: DataFrame,
    keys: Sequence[str],
    tie_breaks: Sequence[str] = (SOURCE_RANK, "release_date"),
) -> DataFrame:
    """One row per key: first non-empty fields, weighted rating, votes, sources.

    Rows rank by votes. A rating counts with its votes, or once if it has none.
    The vote count is the highest one; a group without any gets its number of
    ratings. Sources are the sorted distinct names joined by ``+``.
    """
    types = {f.name: f.dataType for f in df.schema}
    fields = [c for c in FIELDS if c in types and c not in keys]
    # What only rows with a field need is one value, null in all others: most rows may be
    # ratings alone, and every row is sorted by its key within its task.
    order = _row_order([c for c in tie_breaks if c in types and c not in keys])
    held = [order.alias("_order"), *[F.col(f"`{c}`") for c in [*fields, *(["title_norm"] if "title" in fields else [])]]]
    known = reduce(Column.__or__, [F.col(f"`{c}`").isNotNull() for c in fields], F.lit(False))
    plain = [c for c in ("rating", "vote_count", "source", SOURCE_RANK) if c not in keys]
    narrow = df.select(*keys, F.when(known, F.struct(*held)).alias("_fields"), *plain)

    def best(name: str) -> Column:
        value = F.col("_fields")[name]
        carried = [value.alias("value")]
        if name == "title":
            carried.append(F.col("_fields")["title_norm"].alias("title_norm"))
        candidate = F.when(~is_empty(value, types[name]), F.struct(F.col("_fields")["_order"].alias("_order"), *carried))
        return F.min(candidate).alias(name)

    # Decimals add up to the same sum in any order.
    weight = F.coalesce(F.col("vote_count"), F.lit(1)).cast("bigint")
    weighted = F.col("rating").try_cast("decimal(18,10)") * weight.cast("decimal(10,0)")
    rated = F.col("rating").isNotNull() & ~F.isnan("rating")
    grouped = narrow.groupBy(*keys).agg(
        *[best(c) for c in fields],
        F.sum(F.when(rated, weighted)).alias("_rating_sum"),
        F.sum(F.when(rated, weight)).alias("_weight_sum"),
        F.max(F.when(rated, F.col("rating"))).alias("_rating"),
        F.count(F.when(rated, True)).alias("_n_rated"),
        F.max("vote_count").alias("_votes"),
        F.count(F.lit(1)).alias("_n"),
        F.collect_set(F.when(~is_empty(F.col("source"), types["source"]), F.col("source"))).alias("_sources"),
        F.min(SOURCE_RANK).alias(SOURCE_RANK),
    )
    result = {c: F.col(c) for c in keys}
    result |= {c: F.col(f"`{c}`.value") for c in fields}
    if "title" in fields:
        result["title_norm"] = F.coalesce(F.col("title.title_norm"), F.lit(""))
    result["movie_id"] = F.lit(None).cast("string")
    result["rating"] = F.when(F.col("_n_rated") == 1, F.col("_rating")).otherwise(
        F.col("_rating_sum").cast("double") / F.col("_weight_sum").cast("double")
    )
    result["vote_count"] = F.coalesce(
        F.col("_votes"),
        F.when((F.col("_n") > 1) & (F.col("_n_rated") > 0), F.col("_n_rated")).cast("int"),
    )
    result["source"] = F.array_join(F.sort_array("_sources"), "+")
    result[SOURCE_RANK] = F.col(SOURCE_RANK)
    return grouped.select(
        *[result[c].alias(c) for c in [*UNIFIED_COLUMNS, SOURCE_RANK]],
        *[result[c].alias(c) for c in keys if c not in UNIFIED_COLUMNS],
    )


def collapse_by_id(df: DataFrame) -> DataFrame:
    """One row per film id; rows without an id are left out."""
    return collapse(df.filter(F.col("imdb_id").isNotNull()), ["imdb_id"])


def resolve(df: DataFrame, stored: bool = False) -> DataFrame:
    """Collapse conformed rows by title id, then by title and year.

    The title key of stage two comes from the collapsed title and year. A row
    with a blank title has nothing to be matched on: with an id it stays on its
    own, without one it passes through untouched and unshuffled.

    Rows are read three times, with and without ids and titles, so they are
    written once first; ``stored`` says that they come from such a table.
    """
    df = df if stored else materialize(df, "conformed")
    no_id = F.col("imdb_id").isNull()
    titled = F.col("title_norm") != ""
    candidates = collapse_by_id(df).unionByName(df.filter(no_id & titled))
    keyed = candidates.withColumns(
        {
            "_key": match_key(F.col("title_norm"), F.col("year")),
            "_alone": F.when(~titled, F.col("imdb_id")),
        }
    )
    merged = collapse(keyed, ["_key", "_alone"], tie_breaks=("imdb_id", SOURCE_RANK, "release_date"))
    untitled = df.filter(no_id & ~titled)
    return merged.select(*df.columns).unionByName(untitled.select(*df.columns))
