from catalog_fusion.llm.template_leaks import find_leaks

PEARS = "she has 12 apples in the big red basket and her brother brings home exactly 5 pears from the old garden today"
TWICE = "she has 12 apples in the big red basket and her brother brings 12 pears from the old garden near town"


def found(spark, text, item):
    """Windows and share of the one item found in the text, and whether it is verbatim."""
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    return [(r["windows"], round(r["share"], 9), r["verbatim"]) for r in find_leaks(docs, items, share=0.0).collect()]


def test_new_values_may_coincide(spark):
    windows = len(PEARS.split()) - 7
    assert found(spark, PEARS.replace("12", "7").replace("5", "8"), PEARS) == [(windows, 1.0, False)]
    assert found(spark, PEARS.replace("12", "7").replace("5", "7"), PEARS) == [(windows, 1.0, False)]


def test_a_clash_takes_only_the_windows_that_hold_it(spark):
    altered = TWICE.replace("12 apples", "13 apples")
    windows = len(TWICE.split()) - 7
    # The altered word is the third: three windows hold it.
    assert found(spark, altered, TWICE) == [(windows - 3, round((windows - 3) / windows, 9), True)]
    # The same in a copy with other values: the reading of more windows stands.
    assert found(spark, altered.replace("12", "31"), TWICE) == [(windows - 3, round((windows - 3) / windows, 9), False)]
    # Text with the item's shape only: no reading holds all along.
    shape = TWICE.replace("12 apples", "1 apples").replace("12 pears", "2 pears")
    assert found(spark, shape, TWICE) == [(windows - 3, round((windows - 3) / windows, 9), False)]


def test_names_that_open_sentences_are_placeholders_as_well(spark):
    item = "Anna has 12 apples. Boris gives 5 pears to Clara. Dora eats 3 plums today. How many are left?"
    text = "Emma has 31 apples. Frank gives 8 pears to Greta. Hanna eats 9 plums today. How many are left?"
    assert found(spark, text, item) == [(12, 1.0, False)]
    assert found(spark, item, item) == [(12, 1.0, True)]
    # As a name behind a colon, as a literal behind a stop.
    asked = "What is the sum of 5 apples and all pears"
    assert found(spark, "Question: " + asked, asked) == [(3, 1.0, True)]
