"""Features and their preparation as Spark ML stages, so that one pipeline holds a whole model."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_fusion.functions.features import ENCODED_KEYS, FEATURES, prepare_features
from catalog_fusion.operators.encode import TargetEncoder
from catalog_fusion.operators.evaluate import medians

# Features that a film can lack; the others are always known.
OPTIONAL = ["year", "month", "dayofweek", "release_hour", "runtime_min", "budget_log", "vote_count_log"]
TREE_INPUT, RIDGE_INPUT = "tree_features", "ridge_features"


def feature_frame(df: DataFrame, encoder: TargetEncoder) -> DataFrame:
    """The 31 features in order, as floats, beside the input row in ``row``."""
    rows = df.withColumn("row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    encoded = encoder.transform(prepare_features(rows))
    return encoded.select("row", *[F.col(c).cast("float").alias(c) for c in FEATURES])


class FeatureBuilder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the encoders of the features to titles with a rating."""

    labelCol = Param(Params._dummy(), "labelCol", "column of the rating", TypeConverters.toString)

    def __init__(self, labelCol: str = "rating"):
        super().__init__()
        self._setDefault(labelCol="rating")
        self._set(labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> FeatureBuilderModel:
        label = self.getOrDefault(self.labelCol)
        return FeatureBuilderModel(TargetEncoder.fit(prepare_features(dataset), ENCODED_KEYS, label), label)


class FeatureBuilderModel(Model, MLReadable, MLWritable):
    """The 31 features of titles, beside the title in ``row`` and its rating where it has one."""

    labelCol = FeatureBuilder.labelCol
    default = Param(Params._dummy(), "default", "encoding of unseen keys", TypeConverters.toFloat)

    def __init__(self, encoder: TargetEncoder, label: str = "rating"):
        super().__init__()
        self.encoder = encoder
        self._set(labelCol=label, default=float(encoder.default))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        label, rows = self.getOrDefault(self.labelCol), feature_frame(dataset, self.encoder)
        return rows.withColumn(label, F.col(f"row.{label}").cast("double")) if label in dataset.columns else rows

    def write(self) -> MLWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeatureReader()


class _FeatureWriter(MLWriter):
    def __init__(self, instance: FeatureBuilderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.encoder.table.write.parquet(f"{path}/encoder")


class _FeatureReader(MLReader):
    def load(self, path: str) -> FeatureBuilderModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        given = metadata["paramMap"]
        encoder = TargetEncoder.of(spark.read.parquet(f"{path}/encoder"), given["default"], ENCODED_KEYS)
        model = FeatureBuilderModel(encoder, given["labelCol"])
        model._resetUid(metadata["uid"])
        return model


class Preparation(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits median imputation, missing flags and the input vectors of both models.

    A feature that the training rows never have carries nothing and is left out.
    """

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        known = dataset.agg(*[F.count(F.col(c)).alias(c) for c in OPTIONAL]).first()
        empty = {c for c in OPTIONAL if known[c] == 0}
        optional = [c for c in OPTIONAL if c not in empty]
        used = [c for c in FEATURES if c not in empty]
        middle = medians(dataset, optional) if optional else {}
        values = ", ".join(f"CAST(coalesce({c}, {middle[c]!r}D) AS DOUBLE) AS {c}_filled" for c in optional)
        flags = ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}_missing" for c in optional)
        filled = [f"{c}_filled" if c in optional else c for c in used]
        stages: list[Transformer | Estimator] = [SQLTransformer(statement=f"SELECT *, {flags}, {values} FROM __THIS__")] if optional else []
        stages += [
            VectorAssembler(inputCols=filled, outputCol="filled_features"),
            # A constant feature adds nothing to a linear model and would make its equations singular.
            VarianceThresholdSelector(featuresCol="filled_features", outputCol=RIDGE_INPUT, varianceThreshold=0.0),
            VectorAssembler(inputCols=["filled_features", *[f"{c}_missing" for c in optional]], outputCol=TREE_INPUT),
        ]
        return Pipeline(stages=stages).fit(dataset)

