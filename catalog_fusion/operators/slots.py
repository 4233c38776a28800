"""Ranking of release slots and of feature importances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog_fusion.functions.requests import TOP_N

TOP_FEATURES = 12  # fixed value: length of the importance report


def top_slots(
    slots: DataFrame,
    top_n: int | Column = TOP_N,
    request: str = "request_id",
    score: str = "predicted_rating",
    most: int | None = None,
) -> DataFrame:
    """The best ``top_n`` slots per request, with their rank.

    Scores are rounded first; equal scores keep calendar order. With a fixed
    ``top_n``, or a column and ``most``, its largest value, each task keeps its own
    best rows before the shuffle, so one request with a huge window does not fill a task.
    """
    order = W.partitionBy(request).orderBy(F.desc(score), "release_date", "hour_pos")
    ranked = slots.withColumn(score, F.round(score, 3)).withColumn("slot_rank", F.row_number().over(order))
    if most is not None:
        ranked = ranked.filter(F.col("slot_rank") <= most)
    return ranked.filter(F.col("slot_rank") <= top_n)


def best_slots(slots: DataFrame, request: str = "request_id") -> DataFrame:
    """The first slot of every request."""
    return slots.filter(F.col("slot_rank") == 1)


def top_importances(importances: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The ``n`` largest importances."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
