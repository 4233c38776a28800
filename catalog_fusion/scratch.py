"""Lineage cuts and staging tables, always in a folder the cluster shares."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Paths made within the innermost ``job_scratch``.
_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` of the session.

    A session that names none works below its warehouse, unless that is a local folder
    of one machine of a cluster.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")) and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        folder = f"{warehouse}/_scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a ZSTD Parquet table in the scratch folder and read it back.

    The result survives lost executors, is computed once however often it is
    read, and gives the optimizer true sizes, pruning and push-down.
    """
    path = new_scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables that were made inside.

    For jobs that write their result elsewhere: nothing that is returned may
    still read a scratch table.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
