import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalog_fusion.functions import features, requests
from catalog_fusion.operators import encode, evaluate, profile, slots

FILM = "title string, year int, release_date string, release_hour int, runtime_min int, budget_usd double, genres string, director string, `cast` string, language string, country string, vote_count int"


def film(spark, **given):
    names = [c.split()[0].strip("`") for c in FILM.split(", ")]
    return spark.createDataFrame([tuple(given.get(n) for n in names)], FILM)


def test_calendar_edges(spark):
    cal = lambda **kw: features.with_calendar_features(film(spark, **kw)).first()
    r = cal()
    assert r["season"] == 3 and r["month"] is None and r["dayofweek"] is None
    assert [r[c] for c in features.CALENDAR_FEATURES if c.startswith("is_")] == [0, 0, 0, 0, 0]
    r = cal(release_date="2026-11-20", release_hour=19)
    assert (r["dayofweek"], r["is_friday_evening"], r["is_awards_window"], r["season"], r["year"]) == (4, 1, 1, 3, 2026)
    assert cal(release_date="2026-11-20", release_hour=22)["is_friday_evening"] == 0
    r = cal(release_date="2026-08-01", year=1999)
    assert (r["season"], r["is_summer"], r["is_weekend"], r["year"]) == (2, 0, 1, 1999)
    assert cal(release_date="not a date")["month"] is None


def test_feature_list():
    assert len(features.FEATURES) == 31 and features.FEATURES[0] == "year"
    assert features.FEATURES[10:19] == features.NUMERIC_FEATURES + features.ENCODED_FEATURES
    assert features.GENRE_FEATURES[-2:] == ["genre_sci_fi", "genre_thriller"]


def test_numeric_people_and_genres(spark):
    r = features.prepare_features(
        film(spark, budget_usd=-5.0, cast="A , B", director=" D, E", genres="Sci-Fi,Romance", vote_count=9)
    ).first()
    assert r["budget_log"] == 0 and r["vote_count_log"] == pytest.approx(math.log(10), abs=1e-6) and r["runtime_min"] is None
    assert (r["actor_1"], r["actor_2"], r["actor_3"], r["director"], r["language"]) == ("A", "B", "", "D", "")
    assert r["genre_sci_fi"] == r["genre_romance"] == 1 and r["genre_drama"] == 0
    assert features.prepare_features(film(spark)).first()["budget_log"] is None


def lines(spark):
    keys = [None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"k{i % 41}") for i in range(600)]
    return spark.createDataFrame([(k, float(i % 11)) for i, k in enumerate(keys)], "k string, y double"), keys


def test_encoder_formula(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("b", 8.0), ("b", 8.0)], "k string, y double")
    got = {r["key"]: r["encoded"] for r in encode.target_encoding(df, ["k"], "y").collect()}
    assert got["a"] == pytest.approx((2 * 6 + 18 * 7) / 20) == pytest.approx(6.9)


@pytest.mark.parametrize("bounds", [{}, {"broadcast_bytes": 0}])
def test_encoder_against_brute_force_both_ways(spark, bounds):
    df, keys = lines(spark)
    encoder = encode.TargetEncoder.fit(df, ["k"], "y")
    sums, counts = defaultdict(float), Counter()
    for i, k in enumerate(keys):
        sums[k or ""] += i % 11
        counts[k or ""] += 1
    mean = sum(i % 11 for i in range(600)) / 600
    want = {k: (sums[k] + 18 * mean) / (counts[k] + 18) for k in counts}
    probe = df.select("k").unionByName(spark.createDataFrame([("unseen",), ("\x00" + "7",)], "k string"))
    out = encoder.transform(probe, **bounds).collect()
    assert len(out) == 602
    for r in out:
        assert r["k_enc"] == pytest.approx(want.get(r["k"] or "", mean), rel=1e-6)


def test_encoder_plans(spark):
    df, _ = lines(spark)
    encoder = encode.TargetEncoder.fit(df, ["k"], "y")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    small = plan(encoder.transform(df))
    assert "BroadcastHashJoin" in small and "Exchange hashpartitioning" not in small
    assert "CartesianProduct" not in plan(encoder.transform(df, broadcast_bytes=0))


def test_large_lookup_moves_rows_once_whatever_the_columns(spark):
    df, _ = lines(spark)
    wide = df.withColumns({f"k{i}": F.col("k") for i in range(5)})
    encoder = encode.TargetEncoder.fit(wide, ["k", *[f"k{i}" for i in range(5)]], "y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = encoder.transform(wide, broadcast_bytes=0)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Narrow rows to the lookup, its table, narrow rows back together, and the rows to those.
    assert plan.count("Exchange hashpartitioning") == 4 and plan.count("SortMergeJoin") == 2
    small = encoder.transform(wide)
    assert sorted(map(str, out.collect())) == sorted(map(str, small.select(out.columns).collect()))


def test_frequent_keys_are_not_shuffled(spark):
    """One key with a third of the rows, seen or not in training, fills no task of the lookup."""
    rows = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "new" * 100).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), (F.col("id") % 7).cast("double").alias("y")
    )
    encoder = encode.TargetEncoder.fit(rows.where("id % 3 <> 1"), ["k"], "y")
    keys = {"k": "_key0"}
    numbered = rows.select(F.col("id").alias("_row"), encode._narrow(F.col("k")).alias("_key0"))
    cold = encode.cold_probes(numbered, keys, encode.hot_hashes(numbered, ["_key0"]))
    sizes = [r["count"] for r in cold.repartition(8, "column", "_narrow").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4] and sum(sizes) <= 10_000
    large, small = (encoder.transform(rows, **b).select("id", "k_enc").collect() for b in ({"broadcast_bytes": 0}, {}))
    assert sorted(large) == sorted(small) and len(large) == 30_000


def test_split(spark):
    years = spark.range(1000).select(F.col("id").cast("string").alias("movie_id"), (F.col("id") % 10 + 2000).cast("int").alias("year"))
    split = evaluate.temporal_split(years, [F.col("movie_id")])
    assert (split.method, split.n_train, split.n_test) == ("year", 800, 200)
    assert split.cutoff == pytest.approx(2007.2)  # rank 799.2 lies between the years 2007 and 2008
    assert split.train.join(split.test, "movie_id").count() == 0
    few = years.limit(100)
    split = evaluate.temporal_split(few, [F.col("movie_id")])
    assert (split.method, split.n_train, split.n_test) == ("position", 80, 20)
    assert split.train.count() == 80 and split.test.count() == 20
    assert split.train.agg(F.max("movie_id")).first()[0] < split.test.agg(F.min("movie_id")).first()[0]
    gaps = years.withColumn("year", F.when(F.col("year") > 2000, F.col("year")))
    assert evaluate.temporal_split(gaps, [F.col("movie_id")]).n_without_year == 100


def test_metrics_and_clip(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)], "rating double, prediction double")
    r = evaluate.regression_metrics(df).first()
    assert (r["rmse"], r["mae"], r["r2"]) == (round(math.sqrt(5 / 3), 4), 1.0, round(1 - 5 / 8, 4))
    flat = evaluate.regression_metrics(df.withColumn("rating", F.lit(1.0))).first()
    assert flat["r2"] is None
    clipped = df.select(evaluate.clip_rating(F.col("prediction") * 6 - 12).alias("p")).collect()
    assert [r["p"] for r in clipped] == [1.0, 6.0, 6.0]


def test_median_impute_keeps_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (9.0, None)], "a double, b double")
    out = evaluate.median_impute(df, ["a", "b"]).collect()
    assert sorted(r["a"] for r in out) == [1.0, 3.0, 3.0, 9.0] and all(r["b"] is None for r in out)
    two = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "a double")
    assert sorted(r["a"] for r in evaluate.median_impute(two, ["a"]).collect()) == [1.0, 1.5, 1.5, 2.0]


def test_profile(spark):
    df = spark.createDataFrame([(2000, 5.0), (None, float("nan")), (2002, 7.0)], "year int, rating double")
    out = {r["column"]: (r["count"], r["mean"], r["nulls"]) for r in profile.numeric_profile(df).collect()}
    assert out == {"year": (2.0, 2001.0, 1.0), "rating": (2.0, 6.0, 1.0)}
    text = spark.range(1000).select(F.col("id").cast("string").alias("u"), (F.col("id") % 3).cast("string").alias("c"))
    flags = {r["column"]: r["is_category"] for r in profile.categorical_columns(text, ["u", "c"]).collect()}
    assert flags == {"u": False, "c": True}


def test_slots_equal_scoring_one_by_one(spark):
    wanted = spark.createDataFrame([(1, "2026-11-01", "2026-11-03"), (2, "2026-11-02", "2026-11-02")], "request_id int, window_start string, window_end string")
    grid = requests.slot_grid(wanted).withColumn(
        "predicted_rating", F.when(F.col("release_hour") == 19, 7.0004).otherwise(7.0001)
    )
    out = slots.top_slots(grid, 4).orderBy("request_id", "slot_rank").collect()
    # Both scores round to 7.0, so slots stay in calendar order.
    assert [(r["request_id"], r["release_date"], r["release_hour"]) for r in out][:5] == [
        (1, "2026-11-01", 14), (1, "2026-11-01", 16), (1, "2026-11-01", 18), (1, "2026-11-01", 19), (2, "2026-11-02", 14),
    ]
    assert out[0]["weekday"] == "Sunday"
    assert slots.best_slots(slots.top_slots(grid, 4)).count() == 2
    # Each task keeps its own best rows before the shuffle, with a column as well.
    wish = slots.top_slots(grid.withColumn("wish", F.col("request_id") + 1), F.col("wish"), most=3)
    assert "WindowGroupLimit" in wish._jdf.queryExecution().executedPlan().toString()
    assert {r["request_id"]: r["count"] for r in wish.groupBy("request_id").count().collect()} == {1: 2, 2: 3}
    assert "WindowGroupLimit" in slots.top_slots(grid, 4)._jdf.queryExecution().executedPlan().toString()


def test_slot_window_must_not_end_before_it_starts(spark):
    bad = spark.createDataFrame([(1, "2026-11-03", "2026-11-01")], "request_id int, window_start string, window_end string")
    with pytest.raises(Exception, match="window ends before it starts"):
        requests.slot_grid(bad).collect()


def test_requests(spark):
    raw = spark.createDataFrame([("2026-05-06", 7, "X, Y"), ("", None, None)], "release string, hour int, actors string")
    one, two = requests.conform_requests(raw).collect()
    assert (one["year"], one["release_hour"], one["cast"], one["title"]) == (2026, 7, "X, Y", "Untitled")
    assert (two["year"], two["release_date"], two["release_hour"], two["cast"]) == (None, None, 19, "")
    bodies = spark.createDataFrame(
        [('{"title": "T", "release_date": "2026-11-20"}',), ('{"release_date": "2026-11-20"}',), ('{"title": "T"}',), ("junk",)], "body string"
    )
    out = requests.parse_json_requests(bodies).collect()
    assert [r["reject_reason"] for r in out] == [None, "title is required", "release_date is required", "title is required"]
    assert (out[0]["genres"], out[0]["runtime_min"], out[0]["top_n"], out[0]["language"]) == ("Drama", 120, 8, "tr")
