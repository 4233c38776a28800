"""The merge job: stage every source, resolve duplicates, number, write, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from catalog_fusion.operators.collapse import resolve
from catalog_fusion.operators.conform import SOURCE_RANK, conform, conform_tagged, union_sources
from catalog_fusion.operators.number import assign_movie_ids
from catalog_fusion.schema import UNIFIED_COLUMNS, UNIFIED_SCHEMA
from catalog_fusion.scratch import job_scratch, new_scratch_path
from catalog_fusion.sources.records import Layout, file_number, stage_records
from catalog_fusion.sources.scan import (
    Source,
    is_parquet,
    null_markers_to_null,
    plain_path,
    scan,
    separator_of,
    spread,
    text_layouts,
)
from catalog_fusion.sources.sink import public_form, write_parquet

INGEST_JOBS = 8  # layouts staged at the same time


@dataclass(frozen=True)
class MergeReport:
    input_files: list[str]
    rows_ingested: int
    rows_after_merge: int
    output_path: str

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([Row(**asdict(self))])


def ingest(spark: SparkSession, source: Source, rank: int = 0) -> DataFrame:
    """One source as conformed rows, lazily."""
    return conform(scan(spark, source.path, sep=source.sep), source.label, rank)


def ingest_to_parquet(spark: SparkSession, source: Source, dest: str, rank: int = 0) -> int:
    """Scan, conform and write one source; returns its row count."""
    return write_parquet(ingest(spark, source, rank), dest)


def _source_of(file: str, ranks: dict[str, int]) -> int:
    """The place of the source that a file belongs to: its own, or a folder above."""
    path = plain_path(file)
    while path not in ranks:
        above = path.rpartition("/")[0]
        if above == path or not above:
            raise ValueError(f"{file} belongs to no source")
        path = above
    return ranks[path]


def staged_groups(spark: SparkSession, sources: Sequence[Source], dest: str) -> list[Callable[[], DataFrame]]:
    """A job for each layout of the sources' files, which stores its conformed rows below ``dest``.

    The source of a row comes from its file, so the number of scans and jobs grows with
    the layouts, not with the sources.
    """
    ranks = {plain_path(s.path): i for i, s in enumerate(sources)}
    path, label, number = F.col("_metadata.file_path"), "__label", "__file"
    jobs: list[Callable[[], DataFrame]] = []

    def tagged(rows: DataFrame, files: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
        places = [(f, _source_of(f, ranks)) for f in files]
        lookup = spark.createDataFrame([(f, sources[i].label, i) for f, i in places], f"path string, {label} string, __rank int")
        lookup = lookup.select(file_number(F.col("path")).alias(number), label, "__rank")
        return conform_tagged(rows.join(F.broadcast(lookup), number), label, "__rank", kept)

    def text(layout: Layout, files: list[str], place: str) -> DataFrame:
        def then(cells: DataFrame, kept: list[str]) -> DataFrame:
            return tagged(null_markers_to_null(cells, layout.header), files, kept)

        return stage_records(spark, layout, files, then, place, spread)

    def stored(paths: list[str], place: str) -> DataFrame:
        raw = spark.read.parquet(*paths)
        rows = tagged(raw.select("*", file_number(path).alias(number)), raw.inputFiles())
        write_parquet(rows, place)
        return spark.read.schema(rows.schema).parquet(place)

    separators: dict[str, list[str]] = {}
    for s in sources:
        if not is_parquet(s.path):
            separators.setdefault(s.sep or separator_of(s.path), []).append(s.path)
    for sep, paths in separators.items():
        for layout, files in text_layouts(spark, paths, sep).items():
            jobs.append(partial(text, layout, files, f"{dest}/layout={len(jobs)}"))

    tables = [s.path for s in sources if is_parquet(s.path)]
    schemas: dict[str, list[str]] = {}
    with ThreadPoolExecutor(INGEST_JOBS) as pool:
        for name, schema in zip(tables, pool.map(lambda p: spark.read.parquet(p).schema.json(), tables), strict=True):
            schemas.setdefault(schema, []).append(name)
    for paths in schemas.values():
        jobs.append(partial(stored, paths, f"{dest}/layout={len(jobs)}"))
    return jobs


def stage_sources(spark: SparkSession, sources: Sequence[Source], dest: str) -> tuple[DataFrame, int]:
    """All sources as one stored table of conformed rows, and its row count."""
    # Independent jobs at a time, so that a small layout does not leave the cluster idle.
    with ThreadPoolExecutor(INGEST_JOBS) as pool:
        parts = list(pool.map(inheritable_thread_target(spark)(lambda job: job()), staged_groups(spark, sources, dest)))
    parts = parts or [conform(spark.createDataFrame([], UNIFIED_SCHEMA), "")]
    rows = union_sources([p.select(*[F.col(f"`{c}`") for c in (*UNIFIED_COLUMNS, SOURCE_RANK)]) for p in parts])
    return rows, rows.count()


def fuse(parts: Sequence[DataFrame]) -> DataFrame:
    """Numbered titles from conformed sources."""
    return assign_movie_ids(resolve(union_sources(parts))).select(*UNIFIED_COLUMNS)


def merge_sources(
    spark: SparkSession,
    inputs: Sequence[Source | str],
    output: str,
    staging: str | None = None,
) -> MergeReport:
    """Merge source tables into one table of titles.

    Sources are parsed once, into one staged table, whose scans the resolution's
    filters on id and title reach. What the job stages is deleted when it ends,
    unless the caller names the place.
    """
    sources = [s if isinstance(s, Source) else Source(s) for s in inputs]
    if not sources:
        raise ValueError("at least one source is needed")
    with job_scratch(spark):
        staged, rows = stage_sources(spark, sources, staging or new_scratch_path(spark, "staging"))
        merged = assign_movie_ids(resolve(staged, stored=True)).select(*UNIFIED_COLUMNS)
        written = write_parquet(public_form(merged), output)
    return MergeReport([s.path for s in sources], rows, written, output)


def load_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
