"""Dense global row numbers without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog_fusion.functions.text import match_key
from catalog_fusion.schema import UNIFIED_COLUMNS
from catalog_fusion.scratch import materialize

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position below these bits


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Add ``1..n`` in the given order.

    Rows are range partitioned and sorted once, and written with partition and
    position. The offset of a partition is the size of those before it: one
    small row per partition, which bounds both the window and the broadcast.
    """
    keys = {f"_key{i}": column for i, column in enumerate(order)}
    ranged = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.drop(*keys).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumns(
        {
            "_partition": F.shiftright("_place", _POSITION_BITS),
            "_position": F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
        }
    )
    sizes = placed.groupBy("_partition").agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy("_partition").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_partition", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(F.broadcast(offsets), "_partition").select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_offset") + F.col("_position") + 1).alias(name),
    )


def title_order() -> list[Column]:
    """Title key, then id, then the whole row, then its place.

    The title key is unique except for untitled titles, which may hold much of
    the table, copies included. The last two keys let the ranges divide those.
    """
    return [
        match_key(F.col("title_norm"), F.col("year")),
        F.col("imdb_id").isNull(),
        F.col("imdb_id"),
        F.xxhash64(*[F.col(f"`{c}`") for c in UNIFIED_COLUMNS if c != "movie_id"]),
        F.monotonically_increasing_id(),
    ]


def assign_movie_ids(df: DataFrame) -> DataFrame:
    """Number titles ``mv0000001`` onward in title-key order."""
    numbered = number_rows(df, title_order(), "_n")
    return numbered.withColumn("movie_id", F.format_string("mv%07d", "_n")).drop("_n")
