"""Column profiles and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_fusion.schema import NUMERIC_COLUMNS

# A text column counts as categorical below max(64, rows / 20)
# distinct values.
CATEGORY_FLOOR = 64
CATEGORY_SHARE = 20
# End of fixed values.

_HLL_BITS = 14  # of a sketch of distinct values: 16384 counters at most


def numeric_profile(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    """``(column, count, mean, nulls)`` of the numeric columns present, in one pass."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("no numeric column to profile")

    def profile(name: str):
        value = F.col(f"`{name}`").cast("double")
        known = F.when(~F.isnan(value), value)
        return F.struct(
            F.lit(name).alias("column"),
            F.count(known).cast("double").alias("count"),
            F.avg(known).alias("mean"),
            (F.count(F.lit(1)) - F.count(known)).cast("double").alias("nulls"),
        )

    # One aggregate over the table, then one output row per column.
    return df.agg(F.array(*[profile(c) for c in present]).alias("profiles")).select(F.inline("profiles"))


def categorical_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """``(column, distinct, is_category)``: whether a text column repeats enough.

    Distinct counts are sketches of fixed size unless ``exact`` is asked for.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), *[distinct(F.col(f"`{c}`")).alias(f"_{c}") for c in columns]
    )
    limit = F.greatest(F.lit(CATEGORY_FLOOR), F.floor(F.col("rows") / CATEGORY_SHARE))
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("distinct"), (F.col(f"_{c}") < limit).alias("is_category"))
        for c in columns
    ]
    return counted.select(F.inline(F.array(*rows)))


def profile_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What ``merge_profiles`` needs to know of a table: one small row per column, to be stored.

    Sums and sketches of fixed size, so that tables are profiled one by one, as they
    come, and none is read again. NaN counts as missing; text columns have no sum.
    """
    kinds = dict(df.dtypes)

    def state(name: str):
        value, number = F.col(f"`{name}`"), F.col(f"`{name}`").try_cast("double")
        if kinds[name] == "string":
            known, number = value, F.lit(None).cast("double")
        else:
            known = number = F.when(~F.isnan(number), number)
        return F.struct(
            F.lit(name).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count(known).alias("known"),
            F.sum(number).alias("total"),
            F.hll_sketch_agg(known.cast("string"), F.lit(_HLL_BITS)).alias("distinct"),
            F.kll_sketch_agg_double(number).alias("quantiles"),
        )

    return df.agg(F.array(*[state(c) for c in columns]).alias("states")).select(F.inline("states"))


def merge_profiles(states: DataFrame) -> DataFrame:
    """``(column, count, mean, nulls, distinct, is_category, median)`` of all tables whose states are given.

    Counts and means are exact; distinct values and medians are estimates.
    """
    merged = states.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum("known").alias("known"),
        F.sum("total").alias("total"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )
    limit = F.greatest(F.lit(CATEGORY_FLOOR), F.floor(F.col("rows") / CATEGORY_SHARE))
    return merged.select(
        "column",
        F.col("known").cast("double").alias("count"),
        F.try_divide("total", "known").alias("mean"),
        (F.col("rows") - F.col("known")).cast("double").alias("nulls"),
        "distinct",
        (F.col("distinct") < limit).alias("is_category"),
        F.when(F.col("total").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median"),
    )
