"""Scans of delimited text and Parquet, and discovery of source tables."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_fusion.schema import TEXT_NULL_MARKERS
from catalog_fusion.sources.records import Layout, ends_inside, stage_records

_OVERFLOW = "__overflow"
_HEADERS_AT_A_TIME = 16


@dataclass(frozen=True)
class Source:
    """One input table: a file, or a directory of part files."""

    path: str
    name: str | None = None
    sep: str | None = None

    @property
    def label(self) -> str:
        """Provenance: the given name, or the last path component without its suffix."""
        return self.name or PurePosixPath(self.path).stem


def _file_name(path: str) -> str:
    return PurePosixPath(path).name.lower()


def is_parquet(path: str) -> bool:
    return _file_name(path).endswith(".parquet")


def separator_of(path: str) -> str:
    return "\t" if ".tsv" in _file_name(path) else ","


def null_markers_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null for every text cell that is one of the missing-value markers, in ``columns`` or all."""
    chosen = set(df.columns if columns is None else columns)
    cells = {c: F.col(f"`{c}`") for c in df.columns}
    return df.select(*[F.when(~v.isin(TEXT_NULL_MARKERS), v).alias(c) if c in chosen else v for c, v in cells.items()])


def _plain_headers(cells: Sequence[str]) -> tuple[str, ...]:
    """Column names from header cells: no byte order mark, repeats told apart by a count."""
    names, seen = [], {}
    for i, cell in enumerate(cells):
        name = cell.lstrip("\ufeff").strip() or f"_c{i}"
        count = seen[name.lower()] = seen.get(name.lower(), -1) + 1
        names.append(f"{name}.{count}" if count else name)
    return tuple(names)


_HEADER_BYTES = 1 << 20  # of a header line at most


def _first_record(spark: SparkSession, file: str, sep: str) -> str | None:
    """The first line of a file that is not blank, with the lines that its quotes span."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    reader = jvm.org.apache.hadoop.util.LineReader(stream if codec is None else codec.createInputStream(stream), conf)
    try:
        line, held = jvm.org.apache.hadoop.io.Text(), ""
        while reader.readLine(line, _HEADER_BYTES, _HEADER_BYTES) > 0:
            held = f"{held}\n{line.toString()}" if held else line.toString()
            if held.strip() and not (len(held) < _HEADER_BYTES and ends_inside(held.lstrip("\ufeff"), False, sep)):
                return held
            held = held if held.strip() else ""
        return held or None
    finally:
        reader.close()


def text_layouts(spark: SparkSession, paths: Sequence[str], sep: str) -> dict[Layout, list[str]]:
    """The files below ``paths`` by layout. Only the header of each is read; files without a line are left out."""
    files = sorted(spark.read.text(list(paths)).inputFiles())
    layouts: dict[Layout, list[str]] = {}
    with ThreadPoolExecutor(_HEADERS_AT_A_TIME) as pool:
        for file, record in zip(files, pool.map(lambda f: _first_record(spark, f, sep), files), strict=True):
            if record is not None:
                cells = next(csv.reader(io.StringIO(record.lstrip("\ufeff")), delimiter=sep))
                layouts.setdefault(Layout(_plain_headers(cells), sep), []).append(file)
    return layouts


def read_split_lines(spark: SparkSession, layout: Layout, files: Sequence[str]) -> DataFrame:
    """Files of one layout whose cells hold no line breaks, lazily: every column a string.

    A row with more cells than the header is an error, since it can not be told which are wrong.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*layout.header, _OVERFLOW)])
    raw = spark.read.schema(schema).csv([unquote(f) for f in files], header=True, sep=layout.sep, quote='"', escape='"', encoding="UTF-8")
    long = F.concat(F.lit("a row has more cells than the header: "), F.concat_ws(layout.sep, *[F.col(f"`{c}`") for c in raw.columns]))
    return raw.where(F.when(F.col(_OVERFLOW).isNotNull(), F.raise_error(long).cast("boolean")).otherwise(F.lit(True))).drop(_OVERFLOW)


def scan_text(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    sep: str | None = None,
    columns: Sequence[str] | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """Delimited text with headers; every column stays a string.

    Each file is read by its own header, and line breaks inside quotes are kept: text is
    read once, into a stored table of its cells. Where no cell holds a line break, the
    caller can say so, and the files are scanned lazily as they are. Compression follows
    the file suffix; rows of files that one task has to read whole are spread over the cluster.
    """
    paths = [path] if isinstance(path, str) else list(path)
    parts = []
    for layout, files in text_layouts(spark, paths, sep or separator_of(paths[0])).items():
        wanted = [c for c in layout.header if columns is None or c in columns]

        def shaped(cells: DataFrame, kept: list[str], wanted: list[str] = wanted) -> DataFrame:
            return null_markers_to_null(cells.select(*[F.col(f"`{c}`") for c in wanted], *kept), wanted)

        if line_breaks:
            parts.append(stage_records(spark, layout, files, shaped, spread=spread))
        else:
            parts.append(spread(shaped(read_split_lines(spark, layout, files), []), files))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or []]))
    rows = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts)
    return rows if columns is None else rows.select(*[F.col(f"`{c}`") for c in columns])


def scan_parquet(
    spark: SparkSession, path: str | Sequence[str], *, columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet through the vectorised reader, pruned to ``columns``."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])


def scan(
    spark: SparkSession,
    path: str,
    *,
    sep: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Scan a table, choosing the format by its suffix."""
    if is_parquet(path):
        return scan_parquet(spark, path, columns=columns)
    return scan_text(spark, path, sep=sep, columns=columns)


def spread(df: DataFrame, files: Sequence[str]) -> DataFrame:
    """Rebalance rows of files that cannot be split."""
    return df.hint("rebalance") if any(_file_name(f).endswith(".gz") for f in files) else df


def plain_path(path: str) -> str:
    """A path or file URI without scheme and host, unquoted."""
    return unquote(re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?(?=/)", "", path)).rstrip("/")


def parquet_row_count(spark: SparkSession, path: str) -> DataFrame:
    """Row count of a Parquet table, as one row, from the files' footers alone.

    Counts are pushed down by the newer Parquet reader, which a session of its own selects.
    """
    counting = spark.newSession()
    counting.conf.set("spark.sql.sources.useV1SourceList", "")
    counting.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return counting.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


def discover(spark: SparkSession, root: str) -> list[Source]:
    """All CSV, TSV, Parquet and gzip tables below ``root``, in path order.

    Files named ``part-*`` belong to the directory that holds them, as Spark
    writes them, so a table of many files is one source. Only the listing is
    read, and one row per table reaches the driver.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
        .filter(F.lower("path").rlike(r"\.(csv|tsv|parquet|gz)$"))
    )
    name = F.substring_index("path", "/", -1)
    parent = F.regexp_replace("path", r"/[^/]+$", "")
    tables = (
        files.select(F.when(name.startswith("part-"), parent).otherwise(F.col("path")).alias("table"))
        .distinct()
        .orderBy("table")
    )
    return [Source(row.table) for row in tables.collect()]
