"""Reading the corpus tables and row identities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as a string; a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scan_row() -> Column:
    """An identity for each row of a scanned table.

    Ids may be null or repeated, so operators that need one row per input row
    carry this instead. A task that runs again on the same split gives the same
    numbers, since nothing is shuffled before it.
    """
    return F.monotonically_increasing_id()


#: Of one Arrow batch that a task hands to Python. A single longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Of the texts of a batch that are worked on at once, in characters.
RUN_CHARS = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep what Python workers hold independent of how long the texts are.

    The session keeps the two settings, which later batches in it use as well: results are
    lazy, so they must hold when a result is computed, not when it is described.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows of a table of keys that may be broadcast: 16 bytes each at most.
BROADCAST_KEYS = 1_000_000


def content_key() -> Column:
    """A number for what a document is. Rows that share it are copies with the same id."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def by_keys(rows: DataFrame, value: Column, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose ``value`` is among ``keys``, one column (``left_semi``), or is not (``left_anti``).

    The keys are counted; up to ``BROADCAST_KEYS`` they are broadcast, and beyond that
    joined through a shuffle, which deals hot keys out.
    """
    name = "__key"
    keys = keys.toDF(name).distinct()
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return rows.join(side, value == F.col(name), how)


def result_schema(source: DataFrame, more: str) -> T.StructType:
    """The type of the column ``key`` as it is, and ``more``."""
    added = T.StructType.fromDDL(more)
    return T.StructType([source.schema["key"], *added.fields])


def runs_of(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts, one by one or up to about ``RUN_CHARS`` together."""
    low = held = high = 0
    for size in sizes:
        high, held = high + 1, held + size
        if held >= RUN_CHARS:
            yield low, high
            low, held = high, 0
    if low < high:
        yield low, high
