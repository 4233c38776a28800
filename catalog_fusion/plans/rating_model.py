"""Training, choice, persistence and use of the rating model."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, replace
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
)
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from catalog_fusion.functions.features import (
    ENCODED_FEATURES,
    FEATURES,
    GENRE_FEATURES,
    NUMERIC_FEATURES,
    prepare_features,
    with_calendar_features,
)
from catalog_fusion.functions.requests import SLOT_HOURS, TOP_N, conform_requests, same_calendar, slot_grid, spread_requests, spread_rows
from catalog_fusion.operators.conform import labelled
from catalog_fusion.operators.encode import TargetEncoder
from catalog_fusion.operators.evaluate import clip_rating, metric_columns, temporal_split
from catalog_fusion.operators.number import number_rows, title_order
from catalog_fusion.operators.slots import top_importances, top_slots
from catalog_fusion.plans.stages import RIDGE_INPUT, TREE_INPUT, FeatureBuilder, FeatureBuilderModel, Preparation, feature_frame
from catalog_fusion.scratch import materialize, scratch_dir
from catalog_fusion.sources.sink import write_report

# Fixed values of the two candidate models.
TREE_DEPTH = 6
TREE_RATE = 0.06
TREE_ROUNDS = 280
TREE_MIN_LEAF = 20
TREE_BINS = 255
SEED = 42
RIDGE_ALPHA = 2.5
IMPORTANCE_ROUNDS = 3
IMPORTANCE_SEED = 0
# End of fixed values.

TREES, RIDGE = "GBTRegressor", "Ridge"
# Rows of a partition of the training frame: each round is several jobs over it.
_TRAINING_ROWS = 20_000
# Rows that one task scores, at most.
_SCORED_ROWS = 20_000


def fit_ridge(prepared: DataFrame, alpha: float = RIDGE_ALPHA) -> LinearRegressionModel:
    """Ridge regression with a free intercept, solved exactly in one pass.

    The solver divides the penalty by the rows and by the label's deviation.
    """
    stats = prepared.agg(F.count("rating").alias("n"), F.stddev_pop("rating").alias("sd")).first()
    return LinearRegression(
        featuresCol=RIDGE_INPUT,
        labelCol="rating",
        predictionCol="ridge_prediction",
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        regParam=alpha * (stats["sd"] or 0.0) / stats["n"],
    ).fit(prepared)


def fit_trees(prepared: DataFrame, rounds: int = TREE_ROUNDS) -> GBTRegressionModel:
    """Boosted regression trees; lineage is cut every ten rounds.

    The first tree counts in full, only later ones by the rate: Spark starts from a
    tree where other libraries start from the mean.
    """
    scratch_dir(prepared.sparkSession)
    rows = prepared.count()
    prepared = prepared.repartition(max(1, -(-rows // _TRAINING_ROWS)))
    return tree_regressor(rounds).fit(prepared)


def tree_regressor(rounds: int = TREE_ROUNDS) -> GBTRegressor:
    return GBTRegressor(
        featuresCol=TREE_INPUT,
        labelCol="rating",
        predictionCol="tree_prediction",
        maxDepth=TREE_DEPTH,
        stepSize=TREE_RATE,
        maxIter=rounds,
        minInstancesPerNode=TREE_MIN_LEAF,
        maxBins=TREE_BINS,
        seed=SEED,
        checkpointInterval=10,
    )


def donor_place(place: Column, total: int, key: int) -> Column:
    """A permutation of the places ``1..total``: a turn whose length the key decides.

    Places follow a random order, so a turn pairs rows at random, and no row with itself
    where there are two.
    """
    turn = 1 + zlib.crc32(f"turn {IMPORTANCE_SEED} {key}".encode()) % max(1, total - 1)
    return (place - 1 + turn) % max(1, total) + 1


def rating_pipeline(rounds: int = TREE_ROUNDS) -> Pipeline:
    """Titles with a rating to boosted trees, as one Spark ML pipeline."""
    return Pipeline(stages=[FeatureBuilder(), Preparation(), tree_regressor(rounds)])


def permutation_importance(
    features: DataFrame,
    preparation: PipelineModel,
    trees: GBTRegressionModel,
    rounds: int = IMPORTANCE_ROUNDS,
) -> DataFrame:
    """``(feature, importance)``: growth of the squared error when a feature is shuffled.

    ``features`` holds the rating, the features and a stored uniform ``draw``. Rows are
    numbered once, by their draw; in each round a row takes the values of the one that
    ``donor_place`` names, a permutation keyed by the round: one sort, and even shuffles of
    one kind at every size. Errors are reduced to one number per feature within the tasks.
    """
    dealt = features.select("rating", F.array(*FEATURES).alias("own"), "draw")
    placed = materialize(number_rows(dealt, [F.col("draw"), F.xxhash64("rating", "own")], "place").drop("draw"), "placed")
    total = placed.count()
    donors = placed.select("place", F.col("own").alias("other"))
    wanted = F.explode(F.array(*[donor_place(F.col("place"), total, i) for i in range(rounds)])).alias("place")
    donated = placed.select("rating", "own", wanted).join(donors, "place").select("rating", "own", "other")
    variants = donated.select(
        "rating", "own", "other", F.explode(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1))).alias("index")
    )
    shuffled = variants.select(
        "rating",
        "index",
        *[
            F.when(F.col("index") == i, F.col("other")[i]).otherwise(F.col("own")[i]).alias(c)
            for i, c in enumerate(FEATURES)
        ],
    )

    def squared_error(rows: DataFrame) -> DataFrame:
        scored = trees.transform(preparation.transform(rows))
        error = F.col("tree_prediction") - F.col("rating")
        return scored.withColumn("squared_error", error * error)

    baseline = squared_error(features).agg(F.avg("squared_error")).first()[0]
    names = F.element_at(F.array(*[F.lit(c) for c in FEATURES]), F.col("index") + 1)
    return (
        squared_error(shuffled)
        .groupBy(names.alias("feature"))
        .agg(F.round(F.avg("squared_error") - F.lit(baseline), 5).alias("importance"))
    )


@dataclass(frozen=True)
class RatingModel:
    """A trained model: the encoder, both candidates, and which of them predicts."""

    encoder: TargetEncoder
    preparation: PipelineModel
    trees: GBTRegressionModel
    ridge: LinearRegressionModel
    algorithm: str
    report: dict

    @classmethod
    def fit(cls, titles: DataFrame, rounds: int = TREE_ROUNDS, importance: bool = True) -> RatingModel:
        """Train on older titles, choose by the error on newer ones.

        Ridge is chosen only if its RMSE is strictly lower.
        """
        rated = labelled(titles)
        if rated.isEmpty():
            raise ValueError("no film has a rating")
        split = temporal_split(rated, title_order())
        encoder = FeatureBuilder().fit(split.train).encoder
        train = stored_features(split.train, encoder, "train")
        test = stored_features(split.test, encoder, "test")
        preparation = Preparation().fit(train)
        prepared = preparation.transform(train).select("rating", TREE_INPUT, RIDGE_INPUT)
        trees, ridge = fit_trees(prepared, rounds), fit_ridge(prepared)

        scored = ridge.transform(trees.transform(preparation.transform(test)))
        candidates = {TREES: "tree_prediction", RIDGE: "ridge_prediction"}
        metrics = scored.agg(
            *[
                F.struct(
                    *[
                        value.alias(metric)
                        for metric, value in metric_columns(F.col("rating"), clip_rating(F.col(column))).items()
                    ]
                ).alias(name)
                for name, column in candidates.items()
            ]
        ).first()
        algorithm, other = (RIDGE, TREES) if metrics[RIDGE]["rmse"] < metrics[TREES]["rmse"] else (TREES, RIDGE)
        top = []
        if importance:
            top = top_importances(permutation_importance(test, preparation, trees)).collect()
        report = {
            "algorithm": algorithm,
            "metrics": metrics[algorithm].asDict(),
            "baseline_metrics": metrics[other].asDict(),
            "n_train": split.n_train,
            "n_test": split.n_test,
            "n_without_year": split.n_without_year,
            "split": split.method,
            "cutoff_year": split.cutoff,
            "feature_importances": {row["feature"]: row["importance"] for row in top},
        }
        return cls(encoder, preparation, trees, ridge, algorithm, report)

    @staticmethod
    def spread(rows: DataFrame) -> DataFrame:
        """Rows dealt out over as many tasks as scoring them is worth."""
        return spread_rows(rows, F.lit(1), _SCORED_ROWS)

    def score(self, features: DataFrame) -> tuple[DataFrame, Column]:
        """Rows that hold the features, prepared and scored, and the rating within 1 to 10."""
        prepared = self.preparation.transform(features)
        model, column = (
            (self.ridge, "ridge_prediction") if self.algorithm == RIDGE else (self.trees, "tree_prediction")
        )
        return model.transform(prepared), clip_rating(F.col(column))

    def predict(self, titles: DataFrame, name: str = "predicted_rating") -> DataFrame:
        """Every input row with its predicted rating, held within 1 to 10."""
        scored, rating = self.score(feature_frame(self.spread(titles), self.encoder))
        return scored.select("row.*", rating.alias(name))

    def choosing(self, algorithm: str) -> RatingModel:
        """The same training with the other candidate in use, or the same one."""
        return replace(self, algorithm=algorithm, report={**self.report, "algorithm": algorithm})

    def predict_requests(self, requests: DataFrame) -> DataFrame:
        """Requests with any of the known field names, each with its predicted rating."""
        return self.predict(conform_requests(requests))

    def recommend(
        self,
        requests: DataFrame,
        window_start: str = "window_start",
        window_end: str = "window_end",
        hours: tuple[int, ...] = SLOT_HOURS,
        top_n: int | Column = TOP_N,
        observation: Observation | None = None,
    ) -> DataFrame:
        """The best release slots within each request's window.

        ``requests`` has a unique ``request_id``. Features know a day by its year, month and
        weekday, so each of these is scored once for a request and hour; the best of them
        are at least as many slots as are asked for, and only they become days again.
        ``observation`` counts what is ``scored``.
        """
        known = spread_requests(conform_requests(requests), window_start, window_end, hours)
        # All that does not depend on the slot is computed and looked up once per request.
        encoded = self.encoder.transform(prepare_features(known))
        fixed = [*NUMERIC_FEATURES, *ENCODED_FEATURES, *GENRE_FEATURES]
        carried = ["request_id", *dict.fromkeys([window_start, window_end]), *fixed]
        grid = slot_grid(encoded.select(*carried), window_start, window_end, hours, distinct=True)
        timed = with_calendar_features(grid)
        scored, rating = self.score(timed.withColumns({c: F.col(c).cast("float") for c in FEATURES if c != "release_hour"}))
        most = requests.agg(F.max(top_n)).first()[0] if isinstance(top_n, Column) else top_n
        slots = scored.select(
            "request_id", "release_date", F.col("release_hour").cast("int").alias("release_hour"), "weekday", "hour_pos",
            F.col(window_end).alias("_window_end"), rating.alias("predicted_rating"),
        )
        if observation is not None:
            slots = slots.observe(observation, F.count(F.lit(1)).alias("scored"))
        # A slot among the best is among those of the best first days, as many.
        first = top_slots(slots, most).drop("slot_rank")
        best = top_slots(same_calendar(first, "_window_end").drop("_window_end"), most)
        others = [c for c in known.columns if c not in ("request_id", "release_date", "release_hour", "year", "weekday", "hour_pos")]
        # Sorted, not broadcast: requests are many, however small their file.
        asked = conform_requests(requests)
        limits = asked.select("request_id", (top_n if isinstance(top_n, Column) else F.lit(top_n)).alias("_limit")).hint("merge")
        own = asked.select("request_id", *[F.col(f"`{c}`") for c in others]).hint("merge")
        best = best.join(limits, "request_id").where(F.col("slot_rank") <= F.col("_limit")).drop("_limit")
        return best.withColumn("year", F.substring("release_date", 1, 4).cast("int")).join(own, "request_id")

    def report_frame(self, spark: SparkSession) -> DataFrame:
        """The training report as one row."""
        return spark.createDataFrame([Row(**self.report)], REPORT_SCHEMA)

    def pipeline(self) -> PipelineModel:
        """Features, preparation and both candidates as one Spark ML model."""
        return PipelineModel([FeatureBuilderModel(self.encoder), self.preparation, self.trees, self.ridge])

    def save(self, path: str) -> None:
        """Write the model below ``path``, replacing what is there."""
        self.pipeline().write().overwrite().save(f"{path}/pipeline")
        state = {"kind": _KIND, "report": json.dumps(self.report)}
        write_report(self.encoder.table.sparkSession.createDataFrame([Row(**state)]), f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RatingModel:
        """Read a model written by ``save``; anything else is a ``TypeError``."""
        state = spark.read.json(f"{path}/model").first()
        if state is None or "kind" not in state or state["kind"] != _KIND:
            raise TypeError(f"{path} does not hold a rating model")
        report = json.loads(state["report"])
        features, preparation, trees, ridge = PipelineModel.load(f"{path}/pipeline").stages
        return cls(features.encoder, preparation, trees, ridge, report["algorithm"], report)


_KIND = "rating-model"
REPORT_SCHEMA = (
    "algorithm string, metrics map<string, double>, baseline_metrics map<string, double>, "
    "n_train long, n_test long, n_without_year long, split string, cutoff_year double, "
    "feature_importances map<string, double>"
)


def stored_features(titles: DataFrame, encoder: TargetEncoder, label: str) -> DataFrame:
    """Rating, features and a uniform draw, written once."""
    rows = feature_frame(titles, encoder)
    return materialize(
        rows.select(F.col("row.rating").cast("double").alias("rating"), *FEATURES, F.rand(IMPORTANCE_SEED).alias("draw")), f"{label}-features"
    )


def _as_frame(movie: DataFrame | dict) -> DataFrame:
    if isinstance(movie, DataFrame):
        return movie
    spark = SparkSession.active()
    return spark.createDataFrame([Row(**{k: v for k, v in movie.items() if v is not None})])


def _loaded(model: RatingModel | str) -> RatingModel:
    return model if isinstance(model, RatingModel) else RatingModel.load(SparkSession.active(), model)


def _date(text: str) -> date:
    year, month, day = map(int, text.strip().split("-"))
    return date(year, month, day)


def predict_rating(model: RatingModel | str, movie: DataFrame | dict) -> DataFrame:
    """Predicted ratings of requests: a DataFrame, or one film as a dict."""
    return _loaded(model).predict_requests(_as_frame(movie))


def recommend_release_slots(
    model: RatingModel | str,
    movie: DataFrame | dict,
    window_start: str,
    window_end: str,
    hours: tuple[int, ...] = SLOT_HOURS,
    top_n: int = TOP_N,
) -> DataFrame:
    """Best release slots within one window: for a DataFrame by ``request_id``, or for one film."""
    if _date(window_end) < _date(window_start):
        raise ValueError("the window ends before it starts")
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    requests = _as_frame(movie).withColumns(
        {"window_start": F.lit(window_start), "window_end": F.lit(window_end)}
    )
    if isinstance(movie, dict):
        requests = requests.withColumn("request_id", F.lit(1))
    elif "request_id" not in requests.columns:
        raise ValueError("requests need a unique request_id")
    slots = _loaded(model).recommend(requests, hours=hours, top_n=top_n)
    return slots.select(
        "request_id", "title", "release_date", "release_hour", "weekday", "predicted_rating", "slot_rank"
    )
