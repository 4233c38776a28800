"""The given tables shaped as five sources of titles.

They mirror what the product fuses: a title list, a ratings-only list and a
crew list that share an id, and a budget list and a published-ratings list that
only have title and year. Each source keeps every row of its table; part of the
last two have a year that matches no other source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Written for any SQL dialect; {null} is the null token as a string literal.
ROLE_VIEWS = {
    "basics": """
        SELECT concat('tt', CAST(p_partkey AS varchar(20))) AS tconst,
               CASE WHEN p_partkey % 3 = 0 THEN concat('The ', upper(p_name), '!') ELSE p_name END AS "primaryTitle",
               CAST(1995 + p_partkey % 7 AS varchar(20)) AS "startYear",
               CASE WHEN p_partkey % 25 = 0 THEN {null} ELSE CAST(p_size * 9 AS varchar(20)) END AS "runtimeMinutes",
               CASE p_partkey % 7 WHEN 0 THEN 'action|Adventure' WHEN 1 THEN 'Animation,biography' WHEN 2 THEN 'comedy;Crime'
                    WHEN 3 THEN 'DRAMA|fantasy|drama' WHEN 4 THEN 'horror, Romance' WHEN 5 THEN 'Sci-Fi|thriller'
                    ELSE concat(p_type, '|', lower(p_type)) END AS genres
        FROM part""",
    "ratings": """
        SELECT concat('tt', CAST(l_partkey AS varchar(20))) AS tconst,
               CAST(round(l_discount * 100) AS int) AS "averageRating",
               CAST(l_quantity AS int) AS "numVotes"
        FROM lineitem""",
    "crew": """
        SELECT concat('tt', CAST(p_partkey AS varchar(20))) AS tconst,
               concat(p_brand, '|', p_type, ';', p_name) AS directors,
               {null} AS writers
        FROM part""",
    "budgets": """
        SELECT p_name AS movie,
               CASE WHEN p_partkey % 5 = 2 THEN 1900 ELSE 1995 END + p_partkey % 7 AS release_year,
               concat('$', CAST(CAST(floor(p_retailprice) AS int) AS varchar(20)), ',000') AS production_budget,
               p_brand AS director,
               concat(p_brand, ', ', p_type, ', ', p_name) AS stars,
               CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'tr' END AS language,
               CASE WHEN p_size % 2 = 0 THEN 'US' ELSE 'TR' END AS country,
               p_size % 24 AS release_hour,
               CAST(date_add(DATE '1950-01-01', CAST(p_partkey AS int)) AS varchar(20)) AS released
        FROM part""",
    "published": """
        SELECT p_name AS film,
               CASE WHEN p_partkey % 4 = 1 THEN 1920 ELSE 1995 END + p_partkey % 7 AS release_year,
               CAST((p_partkey * 37) % 121 AS double) / 10 AS avg_rating,
               p_size AS votes,
               CAST(date_add(DATE '1950-06-15', CAST(p_partkey AS int)) AS varchar(20)) AS premiere
        FROM part""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ROLE_VIEWS[name].replace('"', "`").replace("{null}", r"r'\N'")
    for base in ("part", "lineitem"):
        text = text.replace(f"FROM {base}", f"FROM {{{base}}}")
    tables = {t: table(spark, sf_dir, t) for t in ("part", "lineitem") if f"{{{t}}}" in text}
    return spark.sql(text, **tables)
