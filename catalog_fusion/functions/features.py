"""Model features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_fusion.functions.parse import fill_year, parse_date
from catalog_fusion.functions.text import strip
from catalog_fusion.schema import GENRES

# The feature vector, in order, and the calendar windows.
CALENDAR_FEATURES = [
    "year",
    "month",
    "dayofweek",
    "release_hour",
    "is_weekend",
    "is_friday_evening",
    "season",
    "is_awards_window",
    "is_summer",
    "is_january_dump",
]
NUMERIC_FEATURES = ["runtime_min", "budget_log", "vote_count_log"]
ENCODED_KEYS = ["director", "actor_1", "actor_2", "actor_3", "language", "country"]
SEASON_MONTHS = [(12, 1, 2), (3, 4, 5), (6, 7, 8)]
OTHER_SEASON = 3
AWARDS_MONTHS = (11, 12)
SUMMER_MONTHS = (6, 7)
DUMP_MONTHS = (1, 2)
EVENING_HOURS = (17, 21)
FRIDAY, SATURDAY = 4, 5  # Monday is 0
# End of fixed values.

ENCODED_FEATURES = [f"{key}_enc" for key in ENCODED_KEYS]


def genre_feature(genre: str) -> str:
    return "genre_" + genre.lower().replace("-", "_")


GENRE_FEATURES = [genre_feature(genre) for genre in GENRES]
FEATURES = CALENDAR_FEATURES + NUMERIC_FEATURES + ENCODED_FEATURES + GENRE_FEATURES


def _flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("float")


def _season(month: Column) -> Column:
    season = F.lit(OTHER_SEASON)
    for number, months in enumerate(SEASON_MONTHS):
        season = F.when(month.isin(*months), number).otherwise(season)
    return season.cast("float")


def with_calendar_features(df: DataFrame) -> DataFrame:
    """Calendar columns from ``release_date``, ``release_hour`` and ``year`` if given."""
    day = parse_date(F.col("release_date"), df.schema["release_date"].dataType)
    month, weekday = F.month(day), F.weekday(day)
    hour = F.col("release_hour") if "release_hour" in df.columns else F.lit(None).cast("int")
    year = F.col("year") if "year" in df.columns else F.lit(None).cast("int")
    return df.withColumns(
        {
            "year": fill_year(year, day),
            "month": month,
            "dayofweek": weekday,
            "release_hour": hour,
            "is_weekend": _flag(weekday >= SATURDAY),
            "is_friday_evening": _flag((weekday == FRIDAY) & hour.between(*EVENING_HOURS)),
            "season": _season(month),
            "is_awards_window": _flag(month.isin(*AWARDS_MONTHS)),
            "is_summer": _flag(month.isin(*SUMMER_MONTHS)),
            "is_january_dump": _flag(month.isin(*DUMP_MONTHS)),
        }
    )


def log_amount(value: Column) -> Column:
    """``log(1 + x)`` with negative amounts as zero; null stays null."""
    return F.when(value.isNotNull(), F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))).cast("float")


def with_numeric_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "budget_log": log_amount(F.col("budget_usd")),
            "vote_count_log": log_amount(F.col("vote_count")),
            "runtime_min": F.col("runtime_min").cast("float"),
        }
    )


def nth_name(names: Column, index: int) -> Column:
    """The ``index``-th name of a comma list, from 0; blank if there is none."""
    return F.coalesce(strip(F.get(F.split(names, ","), F.lit(index))), F.lit(""))


def with_people(df: DataFrame) -> DataFrame:
    """First three actors and the first director; blanks instead of nulls."""
    actors = {f"actor_{i + 1}": nth_name(F.col("`cast`"), i) for i in range(3)}
    return df.withColumns(
        actors
        | {"director": nth_name(F.col("director"), 0)}
        | {c: F.coalesce(F.col(c), F.lit("")) for c in ("language", "country")}
    )


def with_genre_flags(df: DataFrame) -> DataFrame:
    """One 0/1 column per known genre that occurs in the genre text."""
    genres = F.coalesce(F.col("genres"), F.lit(""))
    return df.withColumns({genre_feature(g): genres.contains(F.lit(g)).cast("float") for g in GENRES})


def prepare_features(df: DataFrame) -> DataFrame:
    """Every feature except the encoded ones, which need a fitted encoder."""
    return with_genre_flags(with_people(with_numeric_features(with_calendar_features(df))))
