"""Records of delimited text, from one pass over its lines.

A line break inside quotes does not end a record, and whether a split of a file begins
inside quotes depends on all before it. A line, and so a run of lines, is a function of two
states: from outside or inside quotes, where does it end? Each split is read as if it began
outside, and reports its function beside its records. Composed in the order of a file, the
functions say how each split really begins. In nearly all files that is outside, and the
records stand; only splits that begin inside are read once more. Records that cross splits
are put together from their pieces, of which a split has two at most.

A cell is quoted if it begins with a quote; other quotes are text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog_fusion.scratch import materialize, new_scratch_path

_QUOTE = '"'
#: What a row is: a record; the start of one that does not end here; the end of one that
#: started before, and the like without its end; how a split ends; the start of the header.
_WHOLE, _START, _END, _THROUGH, _SPLIT, _HEADER = range(6)
_PIECES = (_START, _END, _THROUGH, _HEADER)
_META = ["__file", "__block", "__kind", "__text", "__from_outside", "__from_inside"]
_SCHEMA = "__file long, __block long, __kind int, __text string, __from_outside boolean, __from_inside boolean"


@dataclass(frozen=True)
class Layout:
    """What files of delimited text have in common, so that one scan reads them all."""

    header: tuple[str, ...]
    sep: str


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that begins inside or outside quotes ends inside."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(_QUOTE, at):
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at, inside = at + 1, True
        at = line.find(_QUOTE, at)
        while at >= 0 and line.startswith(_QUOTE, at + 1):
            at = line.find(_QUOTE, at + 2)
        if at < 0:
            return True
        # Text behind the closing quote belongs to the cell, up to the separator.
        at, inside = line.find(sep, at + 1) + 1, False
        if not at:
            return False


class _Split:
    """The lines of one split, in order; ``out`` takes its rows."""

    def __init__(self, file: int, block: int, sep: str, inside: bool, out: list):
        self.file, self.block, self.sep, self.out = file, block, sep, out
        self.begun, self.inside, self.other = inside, inside, True  # ``other``: had it begun inside
        self.pending: list[str] = []
        self.head, self.header = inside, block == 0

    def _emit(self, kind: int, text: str | None, ends: tuple[bool | None, bool | None] = (None, None)) -> None:
        self.out.append(([self.file], [self.block], [kind], [text], [ends[0]], [ends[1]]))

    def _record(self, text: str) -> None:
        if self.head:
            self.head = False
            self._emit(_END, text)
        elif text.strip():
            if self.header:
                self.header = False
            else:
                self._emit(_WHOLE, text)

    def add(self, lines: pa.Array) -> None:
        quoted = pc.match_substring(lines, _QUOTE)
        if not self.inside and not self.header and not pc.any(quoted).as_py():
            # Nothing opens: each line is a record.
            lines = lines.filter(pc.not_equal(pc.utf8_length(pc.utf8_trim_whitespace(lines)), 0))
            n = len(lines)
            ids = (pa.repeat(pa.scalar(v, kind), n) for v, kind in ((self.file, pa.int64()), (self.block, pa.int64()), (_WHOLE, pa.int32())))
            self.out.append((*ids, lines, pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_())))
            return
        for line, has in zip(lines.to_pylist(), quoted.to_pylist(), strict=True):
            if has:
                if self.other != self.inside:
                    self.other = ends_inside(line, self.other, self.sep)
                    self.inside = ends_inside(line, self.inside, self.sep)
                else:
                    self.inside = self.other = ends_inside(line, self.inside, self.sep)
            if self.inside:
                self.pending.append(line)
            elif self.pending:
                self._record("\n".join([*self.pending, line]))
                self.pending = []
            else:
                self._record(line)

    def close(self) -> None:
        if self.pending:
            text = "\n".join(self.pending)
            self._emit(_THROUGH if self.head else _HEADER if self.header else _START, text)
        self._emit(_SPLIT, None, (None if self.begun else self.inside, self.other))


def _records(lines: DataFrame, sep: str, inside: bool) -> DataFrame:
    """Rows of ``_SCHEMA`` from lines in the order of their splits."""

    def batch_of(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        columns = [
            pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x in (row[i] for row in out)]) if out else pa.array([], kind)
            for i, kind in enumerate(kinds)
        ]
        return pa.RecordBatch.from_arrays(columns, names=_META)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None
        for batch in batches:
            out: list = []
            files, blocks = (batch.column(i).to_numpy() for i in (1, 2))
            # Where another split begins.
            cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1 if len(files) else []
            bounds = [0, *map(int, cuts), len(files)]
            for low, high in zip(bounds, bounds[1:], strict=False):
                if low == high:
                    continue
                place = (int(files[low]), int(blocks[low]))
                if split is None or (split.file, split.block) != place:
                    if split is not None:
                        split.out = out  # that of the batch before has gone
                        split.close()
                    split = _Split(*place, sep, inside, out)
                split.out = out
                split.add(batch.column(0).slice(low, high - low).cast(pa.string()))
            yield batch_of(out)
        if split is not None:
            split.out = []
            split.close()
            yield batch_of(split.out)

    return lines.select("value", "__file", "__block").mapInArrow(work, _SCHEMA)


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    place = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    # Bytes that are not UTF-8 are replaced.
    value = F.make_valid_utf8("value").alias("value")
    return spark.read.text([unquote(f) for f in files]).select(value, file_number(place[0]).alias("__file"), place[1].alias("__block"))


def file_number(path: Column) -> Column:
    """A number in place of a file's path, with or without an empty host."""
    return F.xxhash64(F.regexp_replace(path, "^([a-zA-Z0-9+.-]+):///", "$1:/"))


def cells(rows: DataFrame, layout: Layout) -> DataFrame:
    """``__file``, ``__block``, ``__kind``, what ends a split, and the cells of records as the header names them.

    Pieces keep their ``__text``, and so do records with more cells than the header, since it
    can not be told which are wrong.
    """
    width = len(layout.header)
    schema = ", ".join(f"c{i} string" for i in range(width + 1))
    record = F.when(F.col("__kind") == _WHOLE, F.col("__text"))
    read = rows.withColumn("__cells", F.from_csv(record, schema, {"sep": layout.sep, "quote": _QUOTE, "escape": _QUOTE}))
    sound = (F.col("__kind") == _WHOLE) & F.col(f"__cells.c{width}").isNull()
    text = F.when(~sound, F.col("__text")).alias("__text")
    return read.select(*[c for c in _META if c != "__text"], text, *[F.col(f"__cells.c{i}").alias(name) for i, name in enumerate(layout.header)])


def _sound_records(table: DataFrame) -> DataFrame:
    """The records of a stored table; one that is too long is an error, as only now is it sure to be one.

    One expression, which knows whether the split was read as it begins: a check of its own
    could be made before that is known.
    """
    misread = F.col("__misread") if "__misread" in table.columns else F.lit(False)
    long = F.concat(F.lit("a row has more cells than the header: "), F.col("__text"))
    sound = F.when(misread | (F.col("__kind") != _WHOLE), F.lit(False)).when(F.col("__text").isNotNull(), F.raise_error(long).cast("boolean"))
    return table.where(sound.otherwise(F.lit(True))).drop(*_META, "__misread")


def _inside(splits: DataFrame) -> DataFrame:
    """The splits that begin inside quotes: one row for each split of a file is gathered, in its order."""
    ends = F.array_sort(F.collect_list(F.struct("__block", "__from_outside", "__from_inside")))

    def step(held: Column, split: Column) -> Column:
        inside = F.when(held["inside"], split["__from_inside"]).otherwise(split["__from_outside"])
        found = F.when(held["inside"], F.concat(held["found"], F.array(split["__block"]))).otherwise(held["found"])
        return F.struct(inside.alias("inside"), found.alias("found"))

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<bigint>").alias("found"))
    begun = splits.groupBy("__file").agg(ends.alias("ends")).select("__file", F.aggregate("ends", start, step)["found"].alias("found"))
    return begun.select("__file", F.explode("found").alias("__block"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Records from their pieces: a start and the ends that follow it in the file. A header is none."""
    first = F.when(F.col("__kind").isin(_START, _HEADER), 1).otherwise(0)
    order = W.partitionBy("__file").orderBy("__block", first)
    numbered = pieces.withColumn("__number", F.sum(first).over(order)).withColumn("__first", first)
    part = F.struct("__block", (1 - F.col("__first")).alias("later"), "__text")
    whole = numbered.groupBy("__file", "__number").agg(
        F.min("__block").alias("__block"), F.array_sort(F.collect_list(part)).alias("parts"), F.max(F.col("__kind") == _HEADER).alias("header")
    ).where("not header")
    text = F.array_join(F.transform("parts", lambda p: p["__text"]), "\n").alias("__text")
    none = F.lit(None).cast("boolean")
    return whole.select("__file", "__block", F.lit(_WHOLE).alias("__kind"), text, none.alias("__from_outside"), none.alias("__from_inside"))


def stage_records(
    spark: SparkSession,
    layout: Layout,
    files: Sequence[str],
    then: Callable[[DataFrame, list[str]], DataFrame],
    dest: str | None = None,
    spread: Callable[[DataFrame, Sequence[str]], DataFrame] = lambda df, _: df,
) -> DataFrame:
    """The records of files of one layout as a written table of ``then(cells, kept)``.

    ``then`` may reshape the cells; it keeps the columns named in ``kept``. Text is read
    once, except for splits that begin inside quotes.
    """
    dest = dest or new_scratch_path(spark, "records")

    def write(rows: DataFrame, folder: str) -> DataFrame:
        shaped = then(cells(rows, layout), _META)
        shaped.write.option("compression", "zstd").parquet(f"{dest}/{folder}")
        return spark.read.schema(shaped.schema).parquet(f"{dest}/{folder}")

    first = write(spread(_records(_lines(spark, files), layout.sep, False), files), "first")
    splits = first.where(F.col("__kind") == _SPLIT)
    if splits.where("__from_outside").isEmpty():
        return _sound_records(first)
    inside = F.broadcast(materialize(_inside(splits), "inside"))  # a row for each split at most
    place = ["__file", "__block"]
    # The same files, so that they are split alike.
    second = write(_records(_lines(spark, files).join(inside, place, "left_semi"), layout.sep, True), "second")
    begun = first.join(inside.withColumn("__found", F.lit(True)), place, "left").withColumn("__misread", F.col("__found").isNotNull()).drop("__found")
    pieces = [t.where(F.col("__kind").isin(*_PIECES)).select(*place, "__kind", "__text") for t in (begun.where("not __misread"), second)]
    third = write(_joined(pieces[0].unionByName(pieces[1])), "third")
    return _sound_records(begun).unionByName(_sound_records(second)).unionByName(_sound_records(third))
