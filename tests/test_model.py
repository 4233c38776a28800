import math
import zlib
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalog_fusion.checks.queries import titles
from catalog_fusion.functions.features import FEATURES
from catalog_fusion.plans import rating_model as rm
from catalog_fusion.plans import tree_table

WANTED = {
    "title": "Harbour Lights",
    "director": "Brand#12",
    "cast": "Brand#12, PROMO, steel ring",
    "genres": "Crime,Thriller",
    "budget_usd": 1_250_000.0,
    "runtime_min": 101,
    "language": "en",
    "country": "US",
    "release_date": "2027-03-05",
    "release_hour": 18,
}


@pytest.fixture(scope="module")
def catalogue(spark):
    """Fused titles with ratings that follow year, hour and budget closely."""
    rows = titles(spark, "/root/testdata/sf0.01")
    signal = 5 + (F.col("release_hour") - 12) / 8 + F.when(F.col("language") == "tr", 1).otherwise(0)
    return rows.withColumn("rating", F.when(F.col("movie_id") != "mv0000001", signal))


@pytest.fixture(scope="module")
def model(catalogue):
    return rm.RatingModel.fit(catalogue, rounds=8)


def test_training_report(model):
    assert model.report["metrics"]["mae"] < 1.2 and model.report["n_train"] > 50
    assert model.report["split"] == "year" and model.report["n_test"] >= 50
    assert model.report["metrics"]["rmse"] <= model.report["baseline_metrics"]["rmse"]
    importances = list(model.report["feature_importances"].items())
    assert len(importances) == 12
    assert [v for _, v in importances] == sorted((v for _, v in importances), reverse=True)
    assert importances[0][0] in ("release_hour", "language_enc", "country_enc")


def test_ridge_equals_the_closed_form(spark, catalogue, model):
    rows = rm.feature_frame(catalogue.filter("rating is not null"), model.encoder)
    train = rm.materialize(rows.select(F.col("row.rating").alias("rating"), *FEATURES), "t")
    prepared = model.preparation.transform(train)
    ridge = rm.fit_ridge(prepared)
    data = prepared.select("rating", "ridge_features").toPandas()
    x, y = np.stack([v.toArray() for v in data["ridge_features"]]), data["rating"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + rm.RIDGE_ALPHA * np.eye(x.shape[1]), xc.T @ yc)
    np.testing.assert_allclose(ridge.coefficients.toArray(), want, rtol=1e-5, atol=1e-7)


def test_prediction_and_slots(spark, model):
    rating = rm.predict_rating(model, WANTED).first()["predicted_rating"]
    assert 1.0 <= rating <= 10.0
    slots = rm.recommend_release_slots(model, WANTED, "2027-02-20", "2027-03-02", top_n=7).orderBy("slot_rank").collect()
    assert len(slots) == 7
    scores = [s["predicted_rating"] for s in slots]
    assert scores == sorted(scores, reverse=True)
    best = slots[0]
    alone = rm.predict_rating(model, WANTED | {"release_date": best["release_date"], "release_hour": best["release_hour"]})
    assert round(alone.first()["predicted_rating"], 3) == pytest.approx(best["predicted_rating"], abs=1e-9)
    with pytest.raises(ValueError):
        rm.recommend_release_slots(model, WANTED, "2027-11-10", "2027-9-30")


def test_requests_are_encoded_before_slots_are_made(spark, model):
    window = {"window_start": "2027-02-20", "window_end": "2027-03-02"}
    wanted = spark.createDataFrame([WANTED | window | {"request_id": i, "top_n": i + 2} for i in (1, 2)])
    best = model.recommend(wanted, top_n=F.col("top_n"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert plan[plan.index("Generate explode") :].count("BroadcastHashJoin") == 6
    fixed = model.recommend(wanted, top_n=4)
    place = lambda df: sorted((r["request_id"], r["slot_rank"], r["release_date"], r["release_hour"], r["title"], r["year"]) for r in df.collect())
    rows = place(best)
    assert [r[:2] for r in rows] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4)]
    assert set(rows) < set(place(fixed)) and {r[4:] for r in rows} == {("Harbour Lights", 2027)}


def test_scoring_keeps_every_row_and_column(catalogue, model):
    out = model.predict(catalogue)
    assert out.columns == [*catalogue.columns, "predicted_rating"]
    assert out.count() == catalogue.count()
    assert out.filter(~F.col("predicted_rating").between(1, 10)).count() == 0


def test_saved_model_predicts_the_same(spark, catalogue, model, tmp_path):
    path = str(tmp_path / "model")
    model.save(path)
    again = rm.RatingModel.load(spark, path)
    assert again.report == model.report and again.algorithm == model.algorithm
    left = {r["movie_id"]: r["predicted_rating"] for r in model.predict(catalogue).collect()}
    for r in again.predict(catalogue).collect():
        assert math.isclose(r["predicted_rating"], left[r["movie_id"]], rel_tol=1e-12)


def test_loading_anything_else_is_an_error(spark, tmp_path):
    spark.createDataFrame([("x",)], ["kind"]).write.json(str(tmp_path / "model"))
    with pytest.raises(TypeError):
        rm.RatingModel.load(spark, str(tmp_path))


def test_training_needs_ratings(catalogue):
    with pytest.raises(ValueError):
        rm.RatingModel.fit(catalogue.withColumn("rating", F.lit(None).cast("double")))


def test_tree_error_is_bounded(catalogue, model):
    rows = rm.feature_frame(catalogue.filter("rating is not null"), model.encoder)
    features = rows.select(F.col("row.rating").alias("rating"), *FEATURES)
    scored = model.trees.transform(model.preparation.transform(features))
    mae = scored.agg(F.avg(F.abs(F.col("tree_prediction") - F.col("rating")))).first()[0]
    assert mae < 1.2


def test_hot_keys_in_importance(spark, catalogue, model):
    """Only the features that matter gain error, however the rows are dealt."""
    rows = rm.stored_features(catalogue.filter("rating is not null"), model.encoder, "i")
    scores = {r["feature"]: r["importance"] for r in rm.permutation_importance(rows, model.preparation, model.trees).collect()}
    assert set(scores) == set(FEATURES)
    assert scores["release_hour"] > 0.05 > abs(scores["genre_drama"])


def test_importance_equals_pandas(spark, catalogue, model):
    """The same turns of the same order, row by row."""
    rows = rm.stored_features(catalogue.filter("rating is not null"), model.encoder, "i")
    got = {r["feature"]: r["importance"] for r in rm.permutation_importance(rows, model.preparation, model.trees, rounds=2).collect()}
    order = rm.number_rows(rows, [F.col("draw"), F.xxhash64("rating", F.array(*FEATURES))], "place").toPandas().sort_values("place").reset_index(drop=True)
    total, parts = len(order), []
    for key in range(2):
        turn = 1 + zlib.crc32(f"turn {rm.IMPORTANCE_SEED} {key}".encode()) % (total - 1)
        other = order.loc[(np.arange(total) + turn) % total].reset_index(drop=True)
        assert (other["place"] != order["place"]).all()
        parts += [order.assign(**{f: other[f]}, feature=f) for f in FEATURES]
    error = F.avg((F.col("tree_prediction") - F.col("rating")) ** 2).alias("error")
    score = lambda df: model.trees.transform(model.preparation.transform(df))
    variants = spark.createDataFrame(pd.concat(parts).astype(object).where(lambda d: d.notna(), None).drop(columns="place"), f"{rows.schema.simpleString()[7:-1]}, feature string")
    before = score(rows).agg(error).first()["error"]
    want = {r["feature"]: r["error"] - before for r in score(variants).groupBy("feature").agg(error).collect()}
    assert got == pytest.approx(want, abs=2e-5)


def test_importance_sorts_once(catalogue, model):
    rows = rm.stored_features(catalogue.filter("rating is not null"), model.encoder, "i")
    plan = rm.permutation_importance(rows, model.preparation, model.trees)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.count("Join") == 1


def test_places_are_permuted(spark):
    for total in (1, 2, 3, 50):
        places = spark.range(1, total + 1).select(*[rm.donor_place(F.col("id"), total, k).alias(f"p{k}") for k in range(4)]).collect()
        assert all(sorted(r[k] for r in places) == list(range(1, total + 1)) for k in range(4))


def test_slots_equal_the_whole_grid(spark, model):
    window = {"window_start": "2027-01-20", "window_end": "2028-02-10"}
    wanted = spark.createDataFrame([WANTED | window | {"request_id": i, "runtime_min": 90 + i} for i in (1, 2)])
    seen = Observation()
    for kind in (rm.TREES, rm.RIDGE):
        chosen = model.choosing(kind)
        found = chosen.recommend(wanted, top_n=40, observation=seen if kind == rm.TREES else None).collect()
        got = sorted((r["request_id"], r["slot_rank"], r["release_date"], r["release_hour"], r["weekday"], r["predicted_rating"]) for r in found)
        grid = rm.slot_grid(wanted.drop("release_date", "release_hour"))
        scored = chosen.predict_requests(grid).select("request_id", "release_date", "release_hour", "weekday", "hour_pos", "predicted_rating")
        whole = rm.top_slots(scored, 40).collect()
        assert got == sorted((r["request_id"], r["slot_rank"], r["release_date"], r["release_hour"], r["weekday"], r["predicted_rating"]) for r in whole)
    slots = 2 * (date(2028, 2, 10) - date(2027, 1, 20)).days * 6
    assert seen.get["scored"] <= 2 * 504 * 14 / 12 < slots / 2


def test_table_of_trees_scores_the_same(spark, catalogue, model):
    nodes = tree_table.tree_nodes(spark, model.trees)
    assert nodes.select("tree").distinct().count() == len(model.trees.trees)
    scored, _ = model.choosing(rm.TREES).score(rm.feature_frame(catalogue, model.encoder))
    rows = rm.materialize(scored.select(vector_to_array("tree_features").alias("x"), "tree_prediction"), "rows")
    out = tree_table.score_nodes(rows, nodes, F.col("x"), rm.TREE_DEPTH)
    gap = out.agg(F.max(F.abs(F.col("prediction") - F.col("tree_prediction"))).alias("gap"), F.count("prediction").alias("n")).first()
    assert gap["gap"] < 1e-9 and gap["n"] == catalogue.count()
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_one_pipeline_is_saved_and_loaded(catalogue, tmp_path):
    rated = catalogue.filter("rating is not null")
    fitted = rm.rating_pipeline(rounds=3).fit(rated)
    fitted.save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    left, right = (sorted((r["row"]["movie_id"], r["tree_prediction"]) for r in m.transform(catalogue).select("row", "tree_prediction").collect()) for m in (fitted, again))
    assert left == right and len(left) == catalogue.count()
    unfitted = rm.rating_pipeline(rounds=3)
    unfitted.save(str(tmp_path / "u"))
    assert [type(s).__name__ for s in Pipeline.load(str(tmp_path / "u")).getStages()] == ["FeatureBuilder", "Preparation", "GBTRegressor"]
