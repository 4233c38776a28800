"""The same answers in plain SQL, written without the library's way of working.

Parsers are checked against the closed form of what each made-up cell spells,
collapses against window functions over all rows.
"""

from __future__ import annotations

from catalog_fusion.checks.views import ROLE_VIEWS
from catalog_fusion.functions.text import ARTICLES
from catalog_fusion.schema import GENRES

_ARTICLES = ",".join(f"'{word}'" for word in ARTICLES)
_GENRES = f"[{','.join(repr(genre) for genre in GENRES)}]"


def _norm(value: str) -> str:
    words = f"string_split(regexp_replace(replace(lower({value}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w <> '' AND w NOT IN ({_ARTICLES})), ' ')"


_VIEWS = ",\n".join(
    f"v_{name} AS ({text.format(null=chr(39) + chr(92) + 'N' + chr(39))})" for name, text in ROLE_VIEWS.items()
)

_FIELDS = [
    "title", "year", "release_date", "release_hour", "runtime_min", "budget_usd", "genres", "director", '"cast"', "language", "country",
]


def _source(view: str, rank: int, **given: str) -> str:
    """One source in the unified columns, nulls where it has none."""
    types = {"year": "INTEGER", "release_date": "DATE", "release_hour": "INTEGER", "runtime_min": "INTEGER", "budget_usd": "DOUBLE",
             "rating": "DOUBLE", "vote_count": "INTEGER"}
    norm = _norm(given["title"]) if "title" in given else "''"
    columns = ["imdb_id", "title", "title_norm", *_FIELDS[1:], "rating", "vote_count"]
    values = {"title_norm": norm} | given
    picked = ", ".join(
        f"CAST({values.get(c.strip(chr(34)), 'NULL')} AS {types.get(c, 'VARCHAR')}) AS {c}" for c in columns
    )
    return f"SELECT {picked}, '{view}' AS source, {rank} AS source_rank FROM v_{view}"


_GENRE_TEXT = """CASE CAST(substr(tconst, 3) AS INTEGER) % 7 WHEN 0 THEN 'Action,Adventure' WHEN 1 THEN 'Animation,Biography'
    WHEN 2 THEN 'Comedy,Crime' WHEN 3 THEN 'Drama,Fantasy' WHEN 4 THEN 'Horror,Romance' WHEN 5 THEN 'Sci-Fi,Thriller'
    ELSE concat(upper(left(split_part(genres, '|', 1), 1)), lower(substr(split_part(genres, '|', 1), 2))) END"""
_MINUTES = "CAST(nullif(\"runtimeMinutes\", '\\N') AS INTEGER)"

_CONFORMED = f"""
{_VIEWS},
conformed AS (
  {_source("basics", 0, imdb_id="tconst", title='"primaryTitle"', year='"startYear"', genres=_GENRE_TEXT,
           runtime_min=f"CASE WHEN {_MINUTES} BETWEEN 40 AND 400 THEN {_MINUTES} END")}
  UNION ALL
  {_source("ratings", 1, imdb_id="tconst", rating='"averageRating"', vote_count='"numVotes"')}
  UNION ALL
  {_source("crew", 2, imdb_id="tconst", director="concat(split_part(directors, '|', 1), ', ', split_part(split_part(directors, '|', 2), ';', 1))")}
  UNION ALL
  {_source("budgets", 3, title="movie", year="release_year", budget_usd="CAST(regexp_replace(production_budget, '[$,]', '', 'g') AS BIGINT)",
           director="director", cast="stars", language="language", country="country", release_hour="release_hour",
           release_date="released")}
  UNION ALL
  {_source("published", 4, title="film", year="release_year", release_date="premiere",
           rating="CASE WHEN avg_rating <= 10 THEN avg_rating END", vote_count="votes")}
)"""


def _collapse(rows: str, key: str, order: str) -> str:
    """Collapse through explicit row ranks."""

    def first(column: str) -> str:
        return f"arg_min({column}, rn) FILTER (WHERE {column} IS NOT NULL)"

    id_column = "any_value(imdb_id)" if key == "imdb_id" else first("imdb_id")
    weighted = "sum(CAST(rating AS DECIMAL(18,10)) * CAST(coalesce(vote_count, 1) AS DECIMAL(10,0)))"
    return f"""
  SELECT {id_column} AS imdb_id, coalesce(arg_min(title_norm, rn) FILTER (WHERE title IS NOT NULL), '') AS title_norm,
         {", ".join(f"{first(c)} AS {c}" for c in _FIELDS)},
         CASE WHEN count(rating) = 1 THEN max(rating)
              ELSE CAST({weighted} AS DOUBLE) / CAST(sum(CASE WHEN rating IS NOT NULL THEN coalesce(vote_count, 1) END) AS DOUBLE)
         END AS rating,
         CAST(coalesce(max(vote_count), CASE WHEN count(*) > 1 AND count(rating) > 0 THEN count(rating) END) AS INTEGER) AS vote_count,
         string_agg(DISTINCT source, '+' ORDER BY source) AS source, min(source_rank) AS source_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {rows})
  GROUP BY {key}"""


_BY_ID = _CONFORMED + f""",
by_id AS ({_collapse("(SELECT * FROM conformed WHERE imdb_id IS NOT NULL)", "imdb_id",
                     "vote_count DESC NULLS LAST, source_rank, release_date NULLS LAST")})"""

_TITLE_KEY = "concat(title_norm, '|', coalesce(CAST(year AS VARCHAR), ''))"
_MERGED = _BY_ID + f""",
candidates AS (
  SELECT * FROM by_id UNION ALL BY NAME SELECT * FROM conformed WHERE imdb_id IS NULL AND title_norm <> ''
),
keyed AS (
  SELECT *, CASE WHEN title_norm <> '' THEN {_TITLE_KEY} ELSE concat('|', imdb_id) END AS film_key FROM candidates
),
merged AS (
  {_collapse("keyed", "film_key", "vote_count DESC NULLS LAST, imdb_id NULLS LAST, source_rank, release_date NULLS LAST")}
  UNION ALL BY NAME SELECT * FROM conformed WHERE imdb_id IS NULL AND title_norm = ''
),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY {_TITLE_KEY}, imdb_id NULLS LAST) AS n FROM merged
)"""


def _published(rows: str, movie_id: str = "CAST(NULL AS VARCHAR)") -> str:
    fields = ", ".join(c for c in _FIELDS if c not in ("title", "year", "release_date"))
    return f"""
SELECT {movie_id} AS movie_id, imdb_id, title, title_norm, year, strftime(release_date, '%Y-%m-%d') AS release_date,
       {fields}, rating, vote_count, source
FROM {rows}"""


def _profile(rows: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 6) AS mean,
            CAST(count(*) - count({c}) AS DOUBLE) AS nulls FROM {rows}"""
        for c in columns
    )


_ORDERS_BY_YEAR = "(SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 7 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders)"
_RATED = "rated AS (SELECT *, round(l_discount * 100) AS rating FROM lineitem)"


def _encoding(rows: str, column: str, target: str = "rating") -> str:
    key = f"coalesce(CAST({column} AS VARCHAR), '')"
    return f"""
  SELECT '{column}' AS "column", {key} AS key, count({target}) AS n,
         (sum({target}) + 18.0 * (SELECT avg({target}) FROM {rows})) / (count({target}) + 18.0) AS encoded
  FROM {rows} GROUP BY {key}"""


_ODD_KEY = """CASE WHEN l_suppkey % 3 = 0 THEN concat(repeat('k', 3000), CAST(l_suppkey AS varchar(20)))
    WHEN l_suppkey % 3 = 1 THEN concat(chr(0), CAST(l_suppkey % 5 AS varchar(20))) ELSE 'hot' END"""
_ENCODED_LINES = f"""
WITH {_RATED},
keyed AS (SELECT *, {_ODD_KEY} AS odd FROM rated),
older AS (SELECT * FROM keyed WHERE l_shipdate < TIMESTAMP '1996-01-01'),
flag AS ({_encoding("older", "l_returnflag")}),
supp AS ({_encoding("older", "l_suppkey")}),
odds AS ({_encoding("older", "odd")}),
overall AS (SELECT avg(rating) AS mean FROM older)
SELECT l_orderkey, l_linenumber, l_suppkey,
       round(CAST(CAST(coalesce(flag.encoded, overall.mean) AS FLOAT) AS DOUBLE), 4) AS l_returnflag_enc,
       round(CAST(CAST(coalesce(supp.encoded, overall.mean) AS FLOAT) AS DOUBLE), 4) AS l_suppkey_enc,
       round(CAST(CAST(coalesce(odds.encoded, overall.mean) AS FLOAT) AS DOUBLE), 4) AS odd_enc
FROM keyed CROSS JOIN overall
LEFT JOIN flag ON flag.key = l_returnflag
LEFT JOIN supp ON supp.key = CAST(l_suppkey AS VARCHAR)
LEFT JOIN odds ON odds.key = odd"""


def _calendar(rows: str, keep: str) -> str:
    def flag(condition: str) -> str:
        return f"CAST(CASE WHEN {condition} THEN 1 ELSE 0 END AS FLOAT)"

    weekday = "CAST(isodow(release_date) - 1 AS INTEGER)"
    return f"""
SELECT {keep}, CAST(coalesce(year, year(release_date)) AS INTEGER) AS year,
       CAST(month(release_date) AS INTEGER) AS month, {weekday} AS dayofweek, release_hour,
       {flag(weekday + " IN (5, 6)")} AS is_weekend,
       {flag(weekday + " = 4 AND release_hour >= 17 AND release_hour <= 21")} AS is_friday_evening,
       CAST(CASE WHEN month(release_date) IN (12, 1, 2) THEN 0 WHEN month(release_date) BETWEEN 3 AND 5 THEN 1
                 WHEN month(release_date) BETWEEN 6 AND 8 THEN 2 ELSE 3 END AS FLOAT) AS season,
       {flag("month(release_date) > 10")} AS is_awards_window,
       {flag("month(release_date) IN (6, 7)")} AS is_summer,
       {flag("month(release_date) < 3")} AS is_january_dump
FROM {rows}"""


def _log(value: str) -> str:
    return f"round(CAST(CAST(ln(1 + CASE WHEN {value} < 0 THEN 0 ELSE {value} END) AS FLOAT) AS DOUBLE), 4)"


_SLOTS = """
days AS (SELECT DATE '2026-11-01' + CAST(d AS INTEGER) AS day FROM range(10) r(d)),
hours AS (SELECT unnest([14, 16, 18, 19, 20, 21]) AS hour, unnest([0, 1, 2, 3, 4, 5]) AS hour_pos),
grid AS (
  SELECT p_partkey AS request_id, strftime(day, '%Y-%m-%d') AS release_date, CAST(hour AS INTEGER) AS release_hour,
         hour_pos, CAST(year(day) AS INTEGER) AS year, dayname(day) AS weekday,
         round(((p_partkey * 31 + day(day) * 17 + hour * 7) % 400) / 40.0, 3) AS predicted_rating
  FROM part, days, hours
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY predicted_rating DESC, release_date, hour_pos) AS INTEGER) AS slot_rank
  FROM grid
)"""

_PEOPLE = {
    "director": "trim(split_part(coalesce(director, ''), ',', 1))",
    "actor_1": "trim(split_part(coalesce(\"cast\", ''), ',', 1))",
    "actor_2": "trim(split_part(coalesce(\"cast\", ''), ',', 2))",
    "actor_3": "trim(split_part(coalesce(\"cast\", ''), ',', 3))",
    "language": "coalesce(language, '')",
    "country": "coalesce(country, '')",
}
_CALENDAR = [
    "year", "month", "dayofweek", "release_hour", "is_weekend", "is_friday_evening", "season", "is_awards_window", "is_summer", "is_january_dump",
]

_FEATURES_OF_TITLES = f"""
WITH {_MERGED},
people AS (SELECT * REPLACE ({", ".join(f"{v} AS {c}" for c, v in _PEOPLE.items() if not c.startswith("actor"))}),
                  {", ".join(f"{v} AS {c}" for c, v in _PEOPLE.items() if c.startswith("actor"))} FROM merged),
prepared AS ({_calendar("people", ", ".join(["title_norm, runtime_min, genres, vote_count, rating, budget_usd", *_PEOPLE]))}),
cutoff AS (SELECT quantile_cont(year, 0.8) AS cut FROM prepared),
train AS (SELECT prepared.* FROM prepared, cutoff WHERE year < cut),
overall AS (SELECT avg(rating) AS mean FROM train),
{", ".join(f"e_{c} AS ({_encoding('train', c)})" for c in _PEOPLE)}
SELECT {_TITLE_KEY} AS match_key,
       {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*_CALENDAR, "runtime_min"])},
       {_log("budget_usd")} AS budget_log, {_log("vote_count")} AS vote_count_log,
       {", ".join(f"round(CAST(CAST(coalesce(e_{c}.encoded, mean) AS FLOAT) AS DOUBLE), 4) AS {c}_enc" for c in _PEOPLE)},
       {", ".join(f"CAST(CASE WHEN contains(genres, '{g}') THEN 1 ELSE 0 END AS DOUBLE) AS genre_{g.lower().replace('-', '_')}" for g in GENRES)}
FROM prepared CROSS JOIN overall
{" ".join(f"LEFT JOIN e_{c} ON e_{c}.key = prepared.{c}" for c in _PEOPLE)}"""

_TRAINING = f"""
WITH {_MERGED}, r AS (SELECT * FROM merged WHERE rating IS NOT NULL),
c AS (SELECT quantile_cont(year, 0.8) AS cut FROM r),
n AS (SELECT count(*) FILTER (WHERE year < cut) AS train, count(*) FILTER (WHERE year >= cut) AS test,
             count(*) FILTER (WHERE year IS NULL) AS unknown, count(*) AS rows, any_value(cut) AS cut FROM r, c),
report AS (
  SELECT CASE WHEN train >= 200 AND test >= 50 THEN 'year' ELSE 'position' END AS split,
         CAST(CASE WHEN train >= 200 AND test >= 50 THEN cut END AS DOUBLE) AS cutoff_year,
         CAST(CASE WHEN train >= 200 AND test >= 50 THEN train ELSE floor(rows * 0.8) END AS BIGINT) AS n_train,
         CAST(CASE WHEN train >= 200 AND test >= 50 THEN test ELSE rows - floor(rows * 0.8) END AS BIGINT) AS n_test,
         unknown AS n_without_year
  FROM n)"""

# Training and scoring by ridge, all in SQL: the titles that train, their encoders, medians and
# normal equations, which are solved by elimination, one column at a time.
_RIDGE_COLUMNS = [*_CALENDAR, "runtime_min", "budget_log", "vote_count_log", *[f"{c}_enc" for c in _PEOPLE],
                  *[f"genre_{g.lower().replace('-', '_')}" for g in GENRES]]
_OPTIONAL = ["year", "month", "dayofweek", "release_hour", "runtime_min", "budget_log", "vote_count_log"]
_RAW = ["rating", "runtime_min", "genres", "vote_count", "budget_usd", "release_date", "release_hour", "year", "director", '"cast"', "language", "country"]
_REQUESTS = """
  SELECT p_partkey AS request_id, p_brand AS director, concat(p_brand, ', ', p_type) AS "cast", 'Drama' AS genres,
         p_retailprice * 1000 AS budget_usd, p_size + 80 AS runtime_min, '' AS language, '' AS country, CAST(NULL AS INTEGER) AS vote_count
  FROM part"""


def _ridge(wanted: str, keep: str) -> str:
    """``scored``: ``keep`` and ``predicted`` of the rows of ``wanted``, which have raw fields as titles do."""
    logs = "CAST(CAST(ln(1 + CASE WHEN {0} < 0 THEN 0 ELSE {0} END) AS FLOAT) AS DOUBLE)"
    people = ", ".join(f"{v} AS {c}" for c, v in _PEOPLE.items())
    encoded = ", ".join(f"CAST(CAST(coalesce(e_{c}.encoded, mean) AS FLOAT) AS DOUBLE) AS {c}_enc" for c in _PEOPLE)
    genres = ", ".join(f"CASE WHEN contains(genres, '{g}') THEN 1.0 ELSE 0.0 END AS genre_{g.lower().replace('-', '_')}" for g in GENRES)
    filled = ", ".join(f"CAST(coalesce({c}, {c}_middle) AS DOUBLE)" if c in _OPTIONAL else f"CAST({c} AS DOUBLE)" for c in _RIDGE_COLUMNS)
    n = len(_RIDGE_COLUMNS)
    return f"""
WITH RECURSIVE {_MERGED.lstrip().removeprefix("WITH ")},
signal AS (
  SELECT * REPLACE (5 + (coalesce(release_hour, 12) - 12) / 8.0 + CASE WHEN language = 'tr' THEN 0.5 ELSE 0.0 END AS rating)
  FROM merged WHERE rating IS NOT NULL
),
cutoff AS (SELECT quantile_cont(year, 0.8) AS cut FROM signal),
sides AS (SELECT count(*) FILTER (WHERE year < cut) >= 200 AND count(*) FILTER (WHERE year >= cut) >= 50 AS by_year, count(*) AS rows FROM signal, cutoff),
training AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {_TITLE_KEY}, imdb_id NULLS LAST) AS place FROM signal), cutoff, sides
  WHERE CASE WHEN by_year THEN year < cut ELSE place <= floor(rows * 0.8) END
),
wanted AS ({wanted}),
raw AS (
  SELECT true AS trains, place AS item, {", ".join(_RAW)} FROM training
  UNION ALL SELECT false, row_number() OVER (), {", ".join("CAST(NULL AS DOUBLE)" if c == "rating" else c for c in _RAW)} FROM wanted
),
people AS (SELECT trains, item, rating, runtime_min, genres, vote_count, budget_usd, release_date, release_hour, year, {people} FROM raw),
prepared AS ({_calendar("people", ", ".join(["trains, item, rating, runtime_min, genres, vote_count, budget_usd", *_PEOPLE]))}),
train AS (SELECT * FROM prepared WHERE trains),
overall AS (SELECT avg(rating) AS mean FROM train),
{", ".join(f"e_{c} AS ({_encoding('train', c)})" for c in _PEOPLE)},
features AS (
  SELECT trains, item, rating, {", ".join(_CALENDAR)}, runtime_min, {logs.format("budget_usd")} AS budget_log, {logs.format("vote_count")} AS vote_count_log,
         {encoded}, {genres}
  FROM prepared CROSS JOIN overall {" ".join(f"LEFT JOIN e_{c} ON e_{c}.key = prepared.{c}" for c in _PEOPLE)}
),
middles AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}_middle" for c in _OPTIONAL)} FROM features WHERE trains),
vectors AS (SELECT trains, item, rating, [{filled}] AS x FROM features CROSS JOIN middles),
cells AS (SELECT item, rating, unnest(range(1, {n + 1})) AS i, unnest(x) AS v FROM vectors WHERE trains),
centres AS (SELECT i, avg(v) AS centre, avg(rating) AS level FROM cells GROUP BY i),
centred AS (SELECT item, i, v - centre AS v, rating - level AS y FROM cells JOIN centres USING (i)),
products AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 2.5 ELSE 0 END AS p FROM centred a JOIN centred b USING (item) GROUP BY a.i, b.i),
equations AS (
  SELECT list(list_append(row, pull) ORDER BY i) AS rows
  FROM (SELECT i, list(p ORDER BY j) AS row FROM products GROUP BY i) JOIN (SELECT i, sum(v * y) AS pull FROM centred GROUP BY i) USING (i)
),
solved AS (
  SELECT 1 AS k, rows FROM equations
  UNION ALL
  SELECT k + 1, list_transform(rows, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k])
    ELSE list_transform(r, lambda x, j: x - r[k] * rows[k][j] / rows[k][k]) END)
  FROM solved WHERE k <= {n}
),
weights AS (SELECT list_transform(rows, lambda r: r[{n + 1}]) AS w FROM solved WHERE k = {n + 1}),
base AS (SELECT w, any_value(level) - sum(w[i] * centre) AS base FROM weights, centres GROUP BY w),
scored AS (
  SELECT {keep}, greatest(1.0, least(10.0, base + list_dot_product(w, x))) AS predicted
  FROM vectors JOIN (SELECT *, row_number() OVER () AS item FROM wanted) AS given USING (item), base WHERE NOT trains
)"""


_ONE_DAY = f"SELECT *, DATE '2026-11-20' AS release_date, 19 AS release_hour, 2026 AS year FROM ({_REQUESTS})"
_WINDOW_SLOTS = f"""
  SELECT r.*, day AS release_date, hour AS release_hour, CAST(year(day) AS INTEGER) AS year, hour_pos
  FROM ({_REQUESTS}) AS r,
       (SELECT DATE '2026-11-01' + CAST(d AS INTEGER) AS day FROM range(3) t(d)),
       (SELECT unnest([14, 16, 18, 19, 20, 21]) AS hour, unnest([0, 1, 2, 3, 4, 5]) AS hour_pos)"""

# How the forms of request end: the reason, else none.
_REASONS = """CASE event_id % 12 WHEN 0 THEN 'title is required' WHEN 3 THEN 'title is required' WHEN 5 THEN 'release_hour must be a whole number'
    WHEN 6 THEN 'runtime_min must be a whole number' WHEN 8 THEN 'language must be text' WHEN 9 THEN 'title must be text'
    WHEN 10 THEN 'top_n must be at least 1' WHEN 11 THEN 'title is required' END"""

_MODEL_ROWS = """(SELECT p_partkey AS request_id FROM part), (VALUES ('GBTRegressor'), ('Ridge')) AS a(algorithm)"""

ORACLES: dict[str, str] = {
    "scan_formats": " UNION ALL ".join(
        f"""SELECT '{name}' AS format, count(*) AS rows, count(DISTINCT l_partkey) AS ids,
            CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS votes FROM lineitem"""
        for name in ("tsv", "csv", "csv.gz", "parquet")
    ),
    "text_null_markers": """
        SELECT p_partkey, CASE p_partkey % 7 WHEN 4 THEN 'none' WHEN 5 THEN 'N.A.' WHEN 6 THEN '-' END AS note FROM part""",
    "projected_scan": "SELECT o_orderkey, o_orderpriority FROM orders",
    "parquet_rows": "SELECT count(*) AS rows FROM lineitem",
    "fusion_report": f"""WITH {_MERGED}
        SELECT 5 AS inputs, (SELECT count(*) FROM conformed) AS rows_ingested, (SELECT count(*) FROM merged) AS rows_after_merge""",
    "conform_union": f"WITH {_CONFORMED} {_published('conformed')}",
    "null_tokens": """
        SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN '  ' WHEN 4 THEN p_name END AS value, p_partkey % 5 <> 4 AS empty FROM part""",
    "kept_columns": "SELECT p_size, p_partkey FROM part",
    "narrow_types": """
        SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, CAST(l_extendedprice AS FLOAT) AS l_extendedprice,
               CAST(l_discount AS FLOAT) AS l_discount, l_returnflag FROM lineitem""",
    "id_partition": """
        SELECT 'basics' AS source, true AS has_id, count(*) AS rows FROM part
        UNION ALL SELECT 'ratings', true, count(*) FROM lineitem
        UNION ALL SELECT 'crew', true, count(*) FROM part
        UNION ALL SELECT 'budgets', false, count(*) FROM part
        UNION ALL SELECT 'published', false, count(*) FROM part""",
    "labelled_rows": """
        SELECT 'ratings' AS source, count(*) AS rows FROM lineitem
        UNION ALL SELECT 'published', count(*) FROM part WHERE (p_partkey * 37) % 121 <= 100""",
    "normalize_title": f"""
        SELECT CAST(doc_id AS VARCHAR) AS item, {_norm("text")} AS title_norm FROM documents
        UNION ALL
        SELECT concat('tt', p_partkey), {_norm("CASE WHEN p_partkey % 3 = 0 THEN concat('The ', upper(p_name), '!') ELSE p_name END")} FROM part""",
    "parse_money": """
        SELECT o_orderkey, CASE o_orderkey % 7
                 WHEN 0 THEN CASE WHEN trunc(o_totalprice) > 0 THEN trunc(o_totalprice) * 1000 END
                 WHEN 1 THEN trunc(o_totalprice) + 0.25 WHEN 5 THEN trunc(o_totalprice) + 0.5 END AS amount
        FROM orders""",
    "parse_int_bounds": """
        WITH spelled AS (
          SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN CAST(l_quantity AS BIGINT) * 9
                   WHEN 1 THEN CAST(concat('1', CAST(CAST(l_quantity AS INTEGER) + 100 AS VARCHAR)) AS BIGINT)
                   WHEN 3 THEN CAST(l_quantity AS BIGINT) * 10 END AS unbounded
          FROM lineitem)
        SELECT l_orderkey, l_linenumber, CAST(CASE WHEN unbounded >= 40 AND unbounded <= 400 THEN unbounded END AS INTEGER) AS bounded, unbounded
        FROM spelled""",
    "parse_rating": """
        WITH spelled AS (
          SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN round(l_discount * 100) + 0.5
                   WHEN 1 THEN round(l_discount * 100) + l_linenumber WHEN 2 THEN -l_quantity END AS value FROM lineitem)
        SELECT l_orderkey, l_linenumber, CAST(CASE WHEN value >= 0 AND value <= 10 THEN value END AS DOUBLE) AS rating FROM spelled""",
    "name_list": """
        SELECT p_partkey, concat(p_brand, ', ', p_name) AS two, concat(p_brand, ', ', p_name, ', ', p_type, ', ', p_size, ', x') AS five FROM part""",
    "genre_list": """
        SELECT p_partkey, concat(upper(left(p_type, 1)), lower(substr(p_type, 2)), ',Sci-Fi,Drama') AS genres FROM part""",
    "date_year_fill": """
        WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 14 < 10 OR o_orderkey % 14 < 12 AND day(o_orderdate) > 12
                                           THEN CAST(o_orderdate AS DATE) END AS day FROM orders)
        SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS release_date,
               CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1999 ELSE year(day) END AS INTEGER) AS year
        FROM d""",
    "mixed_headers": "SELECT p_partkey, p_name, p_size FROM part",
    "quoted_breaks": """
        SELECT doc_id, concat('a "b",', chr(10), 'c ', replace(text, chr(13), '')) AS text FROM documents""",
    "gzip_parts": "SELECT o_orderkey, o_orderpriority FROM orders",
    "match_keys": f"""
        WITH {_CONFORMED}, wanted AS (SELECT * FROM conformed WHERE source IN ('basics', 'published'))
        SELECT coalesce(imdb_id, concat_ws('/', CAST(release_date AS VARCHAR), CAST(vote_count AS VARCHAR), CAST(rating AS VARCHAR))) AS item,
               imdb_id IS NOT NULL AS has_id, concat(title_norm, '|', year) AS match_key,
               CASE WHEN imdb_id IS NULL THEN concat(title_norm, '|', year) ELSE imdb_id END AS dedup_key
        FROM wanted""",
    "release_moment": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) + INTERVAL 19 HOUR
                 WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) END AS moment FROM events""",
    "request_conform": """
        SELECT p_partkey AS request_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Untitled' END AS title,
               CAST(1995 + p_partkey % 7 AS INTEGER) AS year, concat(1995 + p_partkey % 7, '-05-0', 1 + p_partkey % 9) AS release_date,
               CASE WHEN p_partkey % 3 = 0 THEN 19 ELSE p_size % 24 END AS release_hour, p_size AS runtime_min,
               p_retailprice AS budget_usd, '' AS genres, '' AS director, p_brand AS "cast", '' AS language, '' AS country,
               CAST(NULL AS INTEGER) AS vote_count
        FROM part""",
    "requests_from_json": f"""
        WITH shaped AS (SELECT *, event_id % 12 AS form FROM events)
        SELECT event_id, CASE form WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 3 THEN '' WHEN 0 THEN NULL WHEN 9 THEN NULL WHEN 11 THEN NULL
                                   ELSE 'x' END AS title,
               CASE WHEN form = 1 THEN strftime(ts, '%Y-%m-%d') WHEN form IN (0, 11) THEN NULL ELSE '2026-11-20' END AS release_date,
               CAST(CASE WHEN form IN (2, 4) THEN hour(ts) WHEN form = 5 THEN NULL ELSE 19 END AS INTEGER) AS release_hour,
               CASE WHEN form = 2 THEN 'Crime' ELSE 'Drama' END AS genres,
               CASE WHEN form = 2 THEN 90 WHEN form IN (6, 7) THEN NULL ELSE 120 END AS runtime_min,
               CASE WHEN form = 4 THEN CAST(5000000 AS DOUBLE) END AS budget_usd,
               CASE WHEN form <> 8 THEN 'tr' END AS language, 'TR' AS country,
               CASE WHEN form = 2 THEN 3 WHEN form = 10 THEN 0 ELSE 8 END AS top_n,
               {_REASONS} AS reject_reason
        FROM shaped""",
    "window_rejects": f"""
        SELECT event_id, coalesce({_REASONS}, CASE event_id % 5 WHEN 0 THEN 'the window ends before it starts'
            WHEN 2 THEN 'the window is not two dates' WHEN 4 THEN 'a window is required' END) AS reject_reason FROM events""",
    "collapse_by_id": f"WITH {_BY_ID} {_published('by_id')}",
    "collapse_two_stage": f"WITH {_MERGED} {_published('merged')}",
    "sequential_id": f"WITH {_MERGED} SELECT printf('mv%07d', n) AS movie_id, title_norm, year, imdb_id FROM numbered",
    "row_numbers": """
        SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS n FROM orders""",
    "profile_numeric": f"""
        WITH {_CONFORMED}, c AS (SELECT * FROM conformed)
        {_profile("c", ["year", "release_hour", "runtime_min", "budget_usd", "rating", "vote_count"])}""",
    "profile_lineitem": _profile("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]),
    "categorical_columns": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct, count(DISTINCT {c}) < greatest(64, count(*) // 20) AS is_category FROM part"""
        for c in ("p_name", "p_brand", "p_type")
    ).replace("AS distinct", 'AS "distinct"'),
    "categorical_columns_sketch": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) < greatest(64, count(*) // 20) AS is_category FROM part"""
        for c in ("p_name", "p_brand", "p_type")
    ),
    "profile_merged": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count({v}) AS DOUBLE) AS count, {mean} AS mean, CAST(count(*) - count({v}) AS DOUBLE) AS nulls,
            count(DISTINCT {v}) < greatest(64, count(*) // 20) AS is_category, round(log10(count(DISTINCT {v}))) AS distinct_digits, {known} AS median_known FROM orders"""
        for c, v, mean, known in (
            ("o_totalprice", "CASE WHEN o_orderkey % 9 <> 4 THEN o_totalprice END", "round(avg(CASE WHEN o_orderkey % 9 <> 4 THEN o_totalprice END), 4)", "true"),
            ("o_orderpriority", "o_orderpriority", "CAST(NULL AS DOUBLE)", "CAST(NULL AS BOOLEAN)"),
            ("o_custkey", "o_custkey", "round(avg(o_custkey), 4)", "true"),
        )
    ),
    "year_quantile": f"SELECT CAST(quantile_cont(year, 0.8) AS DOUBLE) AS cutoff FROM {_ORDERS_BY_YEAR}",
    "regression_metrics": """
        WITH s AS (SELECT round(l_discount * 100) AS y, least(greatest(l_quantity / 4 - 1, 1.0), 10.0) AS p FROM lineitem)
        SELECT round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
               round(1 - sum((y - p) ** 2) / sum((y - (SELECT avg(y) FROM s)) ** 2), 4) AS r2 FROM s""",
    "median_impute": """
        WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 3 THEN CAST(p_size AS DOUBLE) END AS p_size FROM part)
        SELECT p_partkey, coalesce(p_size, (SELECT quantile_cont(p_size, 0.5) FROM g)) AS p_size FROM g""",
    "calendar_features": _calendar(
        """(SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) + CAST(user_id % 365 AS INTEGER) END AS release_date,
                   CASE WHEN event_id % 5 > 0 THEN CAST(hour(ts) AS INTEGER) END AS release_hour,
                   CASE WHEN event_id % 3 = 0 THEN 2001 END AS year FROM events)""",
        "event_id",
    ),
    "numeric_transforms": f"""
        SELECT c_custkey, CAST(c_nationkey * 10 AS DOUBLE) AS runtime_min, {_log("c_acctbal")} AS budget_log,
               CASE WHEN c_nationkey > 0 THEN {_log("c_nationkey")} END AS vote_count_log FROM customer""",
    "cast_split": """
        SELECT p_partkey, p_brand AS director, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS language, '' AS country,
               CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE '' END AS actor_1,
               CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS actor_2,
               CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS actor_3
        FROM part""",
    "genre_flags": f"""
        WITH g AS (SELECT p_partkey, {_GENRES}[CAST(p_size % 12 + 1 AS INTEGER)] AS a, {_GENRES}[CAST(p_partkey % 12 + 1 AS INTEGER)] AS b,
                          p_partkey % 11 <> 5 AS known FROM part)
        SELECT p_partkey, {", ".join(
            f"CAST(CASE WHEN known AND (a = '{g}' OR b = '{g}') THEN 1 ELSE 0 END AS FLOAT) AS genre_{g.lower().replace('-', '_')}"
            for g in GENRES)} FROM g""",
    "target_encode_fit": f"""
        WITH {_RATED}, e AS ({_encoding("rated", "l_returnflag")} UNION ALL {_encoding("rated", "l_suppkey")})
        SELECT "column", key, n, round(encoded, 6) AS encoded FROM e""",
    "target_encode_apply": _ENCODED_LINES,
    "target_encode_apply_large": _ENCODED_LINES,
    "temporal_split": f"""
        WITH o AS (SELECT * FROM {_ORDERS_BY_YEAR}), c AS (SELECT quantile_cont(year, 0.8) AS cut FROM o)
        SELECT o_orderkey, year, CASE WHEN year < cut THEN 'train' WHEN year >= cut THEN 'test' END AS split FROM o, c""",
    "split_fallback": """
        SELECT s_suppkey, CASE WHEN row_number() OVER (ORDER BY s_suppkey) <= floor((SELECT count(*) FROM supplier) * 0.8)
                               THEN 'train' ELSE 'test' END AS split FROM supplier""",
    "feature_matrix": _FEATURES_OF_TITLES,
    "slot_grid": f"WITH {_SLOTS} SELECT request_id, release_date, release_hour, year, weekday, predicted_rating FROM grid",
    "topn_slots": f"""WITH {_SLOTS}
        SELECT request_id, release_date, release_hour, weekday, predicted_rating, slot_rank FROM ranked WHERE slot_rank <= 8""",
    "best_slot": f"""WITH {_SLOTS}
        SELECT request_id, release_date, release_hour, predicted_rating FROM ranked WHERE slot_rank = 1""",
    "top_importances": """
        SELECT CAST(l_partkey AS VARCHAR) AS feature, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS importance
        FROM lineitem GROUP BY l_partkey ORDER BY importance DESC, feature LIMIT 12""",
    "training_report": f"{_TRAINING} SELECT split, cutoff_year, n_train, n_test, n_without_year FROM report",
    "train_choose": f"{_TRAINING} SELECT split, n_train, n_test, true AS lower_error_chosen, true AS mae_bounded FROM report",
    "metrics_sink": f"{_TRAINING} SELECT split, n_train, n_test FROM report",
    "ridge_equations": "SELECT true AS holds",
    "batch_score": f"""{_ridge(_ONE_DAY, "request_id")}
        SELECT request_id, 'Ridge' AS algorithm, round(predicted, 4) AS predicted_rating, true AS as_by_table FROM scored
        UNION ALL SELECT p_partkey, 'GBTRegressor', NULL, true FROM part""",
    "single_score": f"""{_ridge(_ONE_DAY, "request_id, budget_usd")}
        SELECT request_id, round(predicted, 4) AS predicted_rating FROM scored ORDER BY budget_usd DESC, request_id LIMIT 1""",
    "recommend_ridge": f"""{_ridge(_WINDOW_SLOTS, "request_id, release_date, release_hour, hour_pos")}
        SELECT request_id, strftime(release_date, '%Y-%m-%d') AS release_date, release_hour, round(predicted, 3) AS predicted_rating,
               CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(predicted, 3) DESC, release_date, hour_pos) AS INTEGER) AS slot_rank
        FROM scored QUALIFY slot_rank <= 5""",
    "tree_descent": """
        WITH nodes AS (
          SELECT p_brand, round(avg(p_size), 4) AS size_at, round(avg(p_retailprice), 4) AS price_at, CAST(min(p_size) AS DOUBLE) AS small,
                 CAST(max(p_size) AS DOUBLE) AS large, CAST(count(*) AS DOUBLE) AS many, 1.0 / row_number() OVER (ORDER BY p_brand) AS weight
          FROM part GROUP BY p_brand
        )
        SELECT p_partkey, round(sum(weight * CASE WHEN p_size <= size_at THEN small WHEN p_retailprice <= price_at THEN large ELSE many END), 6) AS prediction
        FROM part, nodes GROUP BY p_partkey""",
    "median_impute_prices": """
        WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 5 THEN l_extendedprice END AS l_extendedprice,
                          CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM g)), 6) AS l_extendedprice,
               round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM g)), 6) AS l_discount FROM g""",
    "recommend": f"""
        SELECT request_id, algorithm, slot_rank, true AS in_window, true AS falling, true AS as_alone
        FROM {_MODEL_ROWS}, (VALUES (1), (2), (3), (4), (5)) AS r(slot_rank)""",
    "recommend_top_n": "SELECT p_partkey AS request_id, p_partkey % 4 + 1 AS slots, CAST(p_partkey % 4 + 1 AS INTEGER) AS last_rank FROM part",
    "feature_importance": """
        SELECT CAST(rank AS INTEGER) AS rank, true AS falling, true AS planted_leads FROM range(1, 13) AS r(rank)""",
    "saved_model": f"SELECT request_id, algorithm, true AS same FROM {_MODEL_ROWS}",
}
ORACLES["merge_job"] = f"""WITH {_MERGED} {_published("numbered", "printf('mv%07d', n)")}"""
