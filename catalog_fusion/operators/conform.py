"""From any source layout to clean rows of the unified film table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_fusion.functions import parse, text
from catalog_fusion.schema import (
    HEADER_ALIASES,
    HOUR_RANGE,
    MAX_CAST,
    MAX_DIRECTORS,
    NULL_TOKENS,
    RATING_RANGE,
    RUNTIME_RANGE,
    UNIFIED_COLUMNS,
    UNIFIED_SCHEMA,
    VOTE_RANGE,
    YEAR_RANGE,
)

SOURCE_RANK = "source_rank"


def unified_name(header: str) -> str | None:
    """The unified column a raw header stands for, if any."""
    key = header.strip().lower().replace(" ", "_")
    target = HEADER_ALIASES.get(key, key)
    return target if target in UNIFIED_COLUMNS else None


def rename_aliases(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Select the columns that map to the unified table, and those in ``also``.

    Of the columns that stand for one, the first wins.
    """
    claimed: dict[str, str] = {}
    for header in df.columns:
        target = None if header in also else unified_name(header)
        if target is not None:
            claimed.setdefault(target, header)
    return df.select(*[F.col(f"`{raw}`").alias(target) for target, raw in claimed.items()], *also)


def conform_schema(df: DataFrame, source: str | Column, also: Sequence[str] = ()) -> DataFrame:
    """All unified columns in order, null where missing; ``source`` by default ``source``."""

    def column(field: T.StructField) -> str:
        if field.name in df.columns:
            return f"`{field.name}`"
        return f"CAST({'NULL' if field.name != 'title_norm' else repr('')} AS {field.dataType.simpleString()}) AS `{field.name}`"

    default = F.lit(source) if isinstance(source, str) else source
    given = text.blank_to_null(F.col("source").cast("string")) if "source" in df.columns else default
    return df.selectExpr(*[column(f) for f in UNIFIED_SCHEMA], *also).withColumn("source", F.coalesce(given, default))


def replace_null_tokens(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Null for every string cell that is exactly a null token."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    return df.replace(NULL_TOKENS, None, subset=strings) if strings else df


def clean_fields(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Parse, bound and normalise every unified column present in ``df``; keep ``also`` as it is.

    Blank text becomes null, and a usable ``imdb_id`` is one that is not null,
    so that later predicates on it reach the Parquet scan. Values are parsed in
    one projection and checked in the next, so that each is computed once.
    """
    types = {f.name: f.dataType for f in df.schema}
    parsers = {
        "year": parse.parse_int,
        "release_hour": parse.parse_int,
        "runtime_min": parse.parse_int,
        "vote_count": parse.parse_int,
        "budget_usd": parse.parse_money,
        "rating": partial(parse.parse_rating, low=None, high=None),
        "release_date": parse.parse_date,
    }
    normalizers = {
        "title": text.strip,
        "genres": text.normalize_genres,
        "director": partial(text.normalize_name_list, limit=MAX_DIRECTORS),
        "cast": partial(text.normalize_name_list, limit=MAX_CAST),
    }
    ranges = {
        "year": YEAR_RANGE,
        "release_hour": HOUR_RANGE,
        "runtime_min": RUNTIME_RANGE,
        "vote_count": VOTE_RANGE,
        "rating": RATING_RANGE,
    }

    def parsed(name: str) -> Column:
        value = F.col(f"`{name}`")
        if name in parsers:
            return parsers[name](value, data_type=types[name])
        return normalizers.get(name, lambda v: v)(value.cast("string"))

    def checked(name: str) -> Column:
        value = F.col(f"`{name}`")
        if name in ranges:
            value = parse.within(value, *ranges[name])
        elif name == "imdb_id":
            value = F.when(value.rlike(text.USABLE_ID), value)
        elif name not in parsers:
            value = text.blank_to_null(value)
        if name == "year" and "release_date" in types:
            value = parse.fill_year(value, F.col("release_date"))
        return value.cast(UNIFIED_SCHEMA[name].dataType)

    present = [c for c in UNIFIED_COLUMNS if c in types and c != "title_norm"]
    # The id check knows the null tokens; one expression keeps the pushed-down filter cheap.
    values = replace_null_tokens(df, skip=["imdb_id", *also]).select(*[parsed(c).alias(c) for c in present], *also)
    checks = {c: checked(c) for c in present}
    if "title" in types:
        checks["title_norm"] = text.normalize_title(F.col("title"))
    if "release_date" in types and "year" not in types:
        checks["year"] = parse.fill_year(F.lit(None).cast("int"), F.col("release_date"))
    return values.select(*[checks[c].alias(c) for c in UNIFIED_COLUMNS if c in checks], *also)


def conform(df: DataFrame, source: str, rank: int = 0) -> DataFrame:
    """One source as clean unified rows, with its place in the ingest order."""
    unified = conform_schema(clean_fields(rename_aliases(df)), source)
    return unified.withColumn(SOURCE_RANK, F.lit(rank))


def conform_tagged(df: DataFrame, label: str, rank: str, kept: Sequence[str] = ()) -> DataFrame:
    """Several sources of one layout as clean unified rows; two columns name the source of a row.

    Columns in ``kept`` stay as they are.
    """
    also = [label, rank, *kept]
    unified = conform_schema(clean_fields(rename_aliases(df, also), also), F.col(label), also)
    return unified.withColumn(SOURCE_RANK, F.col(rank)).drop(label, rank)


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all conformed sources."""
    return reduce(DataFrame.unionByName, parts)


def keep_columns(df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns of ``keep`` that exist; all of them by default."""
    wanted = df.columns if keep is None else [c for c in keep if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def narrow_types(df: DataFrame) -> DataFrame:
    """Floating columns as 32-bit floats, integral ones as 32-bit integers.

    Integers that do not fit become null.
    """

    def narrowed(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            column = column.cast("float")
        elif isinstance(field.dataType, T.IntegralType):
            column = column.try_cast("int")
        return column.alias(field.name)

    return df.select(*[narrowed(field) for field in df.schema])


def split_by_id(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable film id, and all the others."""
    usable = text.has_id(F.col("imdb_id"))
    return df.filter(usable), df.filter(~usable)


def labelled(df: DataFrame) -> DataFrame:
    """Rows that carry a rating."""
    return df.filter(F.col("rating").isNotNull())


def cast_to_unified(df: DataFrame) -> DataFrame:
    """Exactly the unified columns and types, extra columns dropped."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in UNIFIED_SCHEMA])
