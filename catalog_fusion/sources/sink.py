"""Parquet and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def public_form(df: DataFrame) -> DataFrame:
    """Dates as ``YYYY-MM-DD`` text, as the unified table is published."""
    dates = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})


def write_parquet(df: DataFrame, dest: str, *, mode: str = "overwrite") -> int:
    """Write ZSTD Parquet and return the row count, counted by the write itself."""
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode).option(
        "compression", "zstd"
    ).parquet(dest)
    return written.get["rows"]


def write_report(report: DataFrame, dest: str) -> None:
    """Write a report of one or a few rows as JSON."""
    report.coalesce(1).write.mode("overwrite").json(dest)
