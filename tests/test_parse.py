from datetime import date, datetime

import pytest
from pyspark.sql import types as T

from catalog_fusion.functions import parse
from catalog_fusion.operators import conform


def test_money(column):
    cases = {
        "$3,450,000": 3_450_000.0, "$7.5M": 7.5, "1.200.000": None, "1-2": None, "-5": None, "-": None,
        r"\N": None, "": None, None: None, " 7.": 7.0, ".5": 0.5, "0": None, "abc": None,
    }
    assert column(parse.parse_money, list(cases)) == list(cases.values())
    assert column(lambda c: parse.parse_money(c, T.DoubleType()), [3.5, -1.0, 0.0, float("nan"), None], "double") == [
        3.5, None, None, None, None,
    ]


def test_int(column):
    assert column(lambda c: parse.parse_int(c, 40, 400), ["39.9", "40.9", "400.9", "401", "1,00", " 90 "]) == [
        None, 40, 400, None, 100, 90,
    ]
    assert column(lambda c: parse.parse_int(c, 1870, 2035), ["2035.5", "1d", "inf", "nan", "1e400", "2_000"]) == [
        2035, None, None, None, None, 2000,
    ]
    assert column(lambda c: parse.parse_int(c), ["-1.9", "+3e1", "x", None]) == [-1, 30, None, None]
    numeric = lambda c: parse.parse_int(c, 0, 23, T.DoubleType())
    assert column(numeric, [23.9, -0.5, float("nan"), float("inf"), None], "double") == [23, 0, None, None, None]


def test_rating(column):
    assert column(parse.parse_rating, ["8.4", "11", "-1", "nan", "inf", "7,5", " 10 ", None]) == [
        8.4, None, None, None, None, None, 10.0, None,
    ]


def test_dates(column):
    cases = {
        "2026-11-20": date(2026, 11, 20), "2026-1-2": date(2026, 1, 2), "2026-11-20T19:00": date(2026, 11, 20),
        "2026-11-20 19:00:05": date(2026, 11, 20), "20261120": date(2026, 11, 20), "11/20/2026": date(2026, 11, 20),
        "20 Nov 2026": date(2026, 11, 20), "November 20, 2026": date(2026, 11, 20), "2026-13-01": None,
        "2026-11-20x": None, "2026-02-30": None, "soon": None, None: None, "2019": date(2019, 1, 1),
    }
    assert column(parse.parse_date, list(cases)) == list(cases.values())


def test_release_moment(column):
    cases = {
        "2026-11-20": datetime(2026, 11, 20, 19), "2026-11-20T18:30": datetime(2026, 11, 20, 18, 30),
        " 2026-11-20 08:00:01 ": datetime(2026, 11, 20, 8, 0, 1), "later": None, "2026-11-31": None,
    }
    assert column(parse.parse_release_moment, list(cases)) == list(cases.values())


def test_empty(column):
    assert column(lambda c: parse.is_empty(c, T.StringType()), ["x", " \t ", "", None]) == [False, True, True, True]
    assert column(lambda c: parse.is_empty(c, T.DoubleType()), [0.0, float("nan"), None], "double") == [False, True, True]


def test_first_alias_claims_the_column(spark):
    raw = spark.createDataFrame([("a", "b", "2000", "x")], ["Primary Title", "primaryTitle", " startYear ", "title"])
    renamed = conform.rename_aliases(raw)
    assert renamed.columns == ["title", "year"]
    assert renamed.first()["title"] == "b"


def test_conform_keeps_the_fixed_schema(spark):
    raw = spark.createDataFrame(
        [("The X!", "1850", "2001-02-03", "25", "nan", "own"), (None, "2001", "bad", "5", r"\N", " ")],
        ["film", "release_year", "premiere", "release_hour", "avg_rating", "source"],
    )
    rows = conform.conform(raw, "list").collect()
    assert [r["source"] for r in rows] == ["own", "list"]
    assert [r["title_norm"] for r in rows] == ["x", ""]
    # A year out of range is dropped, then filled from the date.
    assert [r["year"] for r in rows] == [2001, 2001]
    assert [r["release_hour"] for r in rows] == [None, 5]
    assert [r["rating"] for r in rows] == [None, None]
    fill = conform.conform(spark.createDataFrame([("1500-01-01",)], ["released"]), "s").first()
    assert fill["year"] == 1500  # the filled year is not range checked


def test_narrow_types(spark):
    out = conform.narrow_types(spark.createDataFrame([(2**40, 1.5, "a")], "n bigint, x double, s string"))
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "float", "string"]
    assert tuple(out.first()) == (None, 1.5, "a")


def test_keep_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    assert conform.keep_columns(df, ["b", "zzz"]).columns == ["b"]
    assert conform.keep_columns(df).columns == ["a", "b"]


@pytest.mark.parametrize("value,has", [("tt1", True), ("", False), ("  ", False), (None, False)])
def test_split_by_id(spark, value, has):
    with_id, without = conform.split_by_id(spark.createDataFrame([(value,)], "imdb_id string"))
    assert (with_id.count(), without.count()) == ((1, 0) if has else (0, 1))
