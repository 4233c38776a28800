"""The unified film table: its columns, value ranges, header aliases and genres."""

from __future__ import annotations

from pyspark.sql import types as T

# The public table format. Column names and order, accepted
# ranges, header aliases and genre labels have to stay as they are.

UNIFIED_SCHEMA = T.StructType(
    [
        T.StructField("movie_id", T.StringType()),
        T.StructField("imdb_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("title_norm", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("release_date", T.DateType()),
        T.StructField("release_hour", T.IntegerType()),
        T.StructField("runtime_min", T.IntegerType()),
        T.StructField("budget_usd", T.DoubleType()),
        T.StructField("genres", T.StringType()),
        T.StructField("director", T.StringType()),
        T.StructField("cast", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("vote_count", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)

YEAR_RANGE = (1870, 2035)
HOUR_RANGE = (0, 23)
RUNTIME_RANGE = (40, 400)
VOTE_RANGE = (1, 50_000_000)
RATING_RANGE = (0.0, 10.0)
MAX_DIRECTORS = 2
MAX_CAST = 5

HEADER_ALIASES = {
    "tconst": "imdb_id",
    "primarytitle": "title",
    "originaltitle": "title",
    "startyear": "year",
    "runtimeminutes": "runtime_min",
    "averagerating": "rating",
    "numvotes": "vote_count",
    "directors": "director",
    "movie": "title",
    "film": "title",
    "name": "title",
    "release_year": "year",
    "released": "release_date",
    "release": "release_date",
    "premiere": "release_date",
    "runtime": "runtime_min",
    "budget": "budget_usd",
    "production_budget": "budget_usd",
    "genre": "genres",
    "stars": "cast",
    "actors": "cast",
    "cast_names": "cast",
    "avg_rating": "rating",
    "imdb_rating": "rating",
    "votes": "vote_count",
    "original_language": "language",
    "spoken_language": "language",
    "production_country": "country",
    "country_of_origin": "country",
}

GENRES = [
    "Action",
    "Adventure",
    "Animation",
    "Biography",
    "Comedy",
    "Crime",
    "Drama",
    "Fantasy",
    "Horror",
    "Romance",
    "Sci-Fi",
    "Thriller",
]

# Tokens that stand for "no value" in any source, and the further ones that a
# delimited text file may use.
NULL_TOKENS = [r"\N", "nan", ""]
TEXT_NULL_MARKERS = [
    r"\N",
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# End of fixed values.

UNIFIED_COLUMNS = UNIFIED_SCHEMA.fieldNames()
NUMERIC_COLUMNS = [
    f.name for f in UNIFIED_SCHEMA if isinstance(f.dataType, T.NumericType)
]
