import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog_fusion.functions import text

ARTICLES = {"the", "a", "an", "el", "la", "le", "les", "der", "die", "das"}


def expected_title(value):
    folded = unicodedata.normalize("NFKC", value).casefold()
    words = re.findall(r"\w+", folded)
    return " ".join(w for w in words if w not in ARTICLES)


def test_title_cases(column):
    cases = {
        "A Night by the River, Le Retour?": "night by river retour",
        "Işık ve Gölge": "işık ve gölge",
        None: "",
        "Eski İskele": "eski i skele",
        "Straße": "strasse",
        "Once a Thief": "once thief",
        "a_b": "a_b",
        "  The  ": "",
        "ﬁlm Ⅷ": "film viii",
        "ΣΊΣΥΦΟΣ ς": "σίσυφοσ σ",
        "ＦＵＬＬ width": "full width",
        "été": "été",
        "Das\tBoot II": "boot ii",
    }
    assert column(text.normalize_title, list(cases)) == list(cases.values())


def test_title_matches_unicode_rules(spark, column):
    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=25), min_size=40, max_size=40))
    def check(values):
        assert column(text.normalize_title, values) == [expected_title(v) for v in values]

    check()


def test_latin_range_agrees_between_the_two_folding_paths(column):
    values = [f"x{chr(c)}y" for c in range(0x250)]
    assert column(text.normalize_title, values) == [expected_title(v) for v in values]


def test_name_list(column):
    assert column(lambda c: text.normalize_name_list(c, 2), ["A|B; C", None, " ,\\N, x ", ""]) == ["A, B", "", "x", ""]
    assert column(text.normalize_name_list, ["a,b,c,d,e,f"]) == ["a, b, c, d, e"]


def test_genres(column):
    values = ["sci-fi|DRAMA;drama", None, "o'neil, 3d film", "\\N"]
    assert column(text.normalize_genres, values) == ["Sci-Fi,Drama", "", "O'Neil,3D Film", ""]


def test_keys(spark):
    rows = spark.createDataFrame(
        [("tt1", "x", 2000), (" ", "x", 2000), (None, "x", None), ("<NA>", None, 1999)],
        "id string, t string, y int",
    )
    out = rows.select(
        text.has_id(F.col("id")).alias("h"),
        text.match_key(F.col("t"), F.col("y")).alias("m"),
        text.dedup_key(F.col("id"), F.col("t"), F.col("y")).alias("d"),
    ).collect()
    assert [tuple(r) for r in out] == [
        (True, "x|2000", "tt1"),
        (False, "x|2000", "x|2000"),
        (False, "x|", "x|"),
        (False, "|1999", "|1999"),
    ]
