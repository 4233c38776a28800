"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions, and its norm. Angles obey the
triangle inequality, so those of two vectors to a reference bound the angle between them
from both sides; the cosines of the bounds, times both norms, enclose their inner product.
Bounds are widened by more than the error of rounding. Only vectors whose bounds meet an
anchor's window get their exact integer score.

Vectors lie in slices: those nearest to one reference, by bands of the angle to it. The
angles of a slice bound the scores of all its vectors, so an anchor visits the slices that
its window meets. Slices are dealt into chunks of bounded size, and a task scores the
vectors of one chunk for a bounded group of anchors.

A first round searches each anchor's own slice. What it finds narrows the windows of the
round over all other slices. Only the references come from a sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalog_fusion.llm.tables import bound_batches, scan_row
from catalog_fusion.scratch import materialize

#: Reference directions, sampled vectors to choose them from, and bands of the angle to each.
REFERENCES, SAMPLE, BANDS = 16, 2048, 256
#: Vectors of a chunk, and anchors that a task scores them for: about, as hashes deal them.
CHUNK, ANCHORS = 1 << 15, 1 << 15
#: More than the error of an angle from stored ones, and of a product, in parts of both norms.
ANGLE_SLACK, SCORE_SLACK = 2e-6, 1e-9
_EXACT = float(1 << 53)  # up to here sums of products of whole floats are exact
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_LARGEST = float(1 << 62)  # of a component


def integer_scores(anchor: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as floats, held within 64-bit integers."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    if np.abs(anchor).max(initial=0) * np.abs(vectors).max(initial=0) * len(anchor) < _EXACT:
        return np.rint(vectors @ anchor).astype(np.int64)
    whole = [int(a) for a in anchor]
    return np.array([min(_MOST, max(_LEAST, sum(a * int(b) for a, b in zip(whole, v, strict=True)))) for v in vectors], np.int64)


def matrix(lists: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of numbers; shorter ones are filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(int(sizes.max(initial=0)), width or 0)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), values.dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def angles_to(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to unit vectors; a vector of zeros is at right angles to all."""
    width = min(vectors.shape[1], references.shape[1])
    dots = (vectors[:, :width] / np.where(norms > 0, norms, 1.0)[:, None]) @ references[:, :width].T
    return np.arccos(np.clip(dots, -1.0, 1.0))


def norms_of(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, initial=0)
    scaled = vectors / np.where(top > 0, top, 1.0)[:, None]
    return np.sqrt((scaled * scaled).sum(1)) * top


def angle_bounds(anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest angle between an anchor and vectors whose angles lie in ``[low, high]``."""
    least = np.maximum(anchor - high, low - anchor).max(1) - ANGLE_SLACK
    # Two angles to one reference span a half turn at most.
    most = np.minimum(anchor + high, 2 * np.pi - anchor - low).min(1) + ANGLE_SLACK
    return np.clip(least, 0.0, np.pi), np.clip(most, 0.0, np.pi)


def score_bounds(anchor_norm: float, norm_low: np.ndarray, norm_high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Below and above every inner product at such norms and angles."""
    near, far = np.cos(least), np.cos(most)
    slack = 1.0 + SCORE_SLACK * anchor_norm * norm_high
    low = anchor_norm * np.where(far >= 0, norm_low, norm_high) * far - slack
    high = anchor_norm * np.where(near >= 0, norm_high, norm_low) * near + slack
    return low, high


def spread_directions(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` unit vectors, each the farthest in angle from those before it."""
    norms = norms_of(vectors)
    units = vectors[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.zeros((1, vectors.shape[1]))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


@dataclass(frozen=True)
class Slices:
    """Bounds of each slice, and the slice of each band."""

    number: np.ndarray  # [reference, band], -1 where there is none
    chunks: np.ndarray
    angle_low: np.ndarray  # [slice, reference]
    angle_high: np.ndarray
    norm_low: np.ndarray
    norm_high: np.ndarray


def cut_slices(stats: list, references: int) -> Slices:
    """Neighbouring bands of a reference, up to a chunk's rows, or one band with more of them."""
    number = np.full((references, BANDS), -1)
    parts: list[list] = []
    for r in sorted(stats, key=lambda r: (r["cell"], r["band"])):
        if not parts or parts[-1][0]["cell"] != r["cell"] or sum(x["n"] for x in parts[-1]) + r["n"] > CHUNK:
            parts.append([])
        parts[-1].append(r)
        number[r["cell"], r["band"]] = len(parts) - 1
    low = [[min(x[f"low_{j}"] for x in p) for j in range(references)] for p in parts]
    high = [[max(x[f"high_{j}"] for x in p) for j in range(references)] for p in parts]
    return Slices(
        number, np.array([max(1, -(-sum(x["n"] for x in p) // CHUNK)) for p in parts]), np.array(low), np.array(high),
        np.array([min(x["norm_low"] for x in p) for p in parts]), np.array([max(x["norm_high"] for x in p) for p in parts]),
    )


_INDEX = "row long, id long, label long, anchor boolean, v array<double>, norm double, angles array<float>, cell int, band int"


def _taking_part(rows: DataFrame, scale: float) -> DataFrame:
    """Rows with an id, a label and a vector of finite components, as floors of its multiples."""
    whole = rows.where("id is not null and label is not null and vector is not null")
    whole = whole.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = F.transform("vector", lambda x: x * scale)
    return whole.select("row", "id", F.col("label").cast("long").alias("label"), "anchor", scaled.alias("v"))


def _floors(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.floor(np.clip(matrix(lists), -_LARGEST, _LARGEST))


def _indexed(rows: DataFrame, references: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = _floors(batch.column("v"))
            norms = norms_of(v)
            angles = angles_to(v, norms, references).astype(np.float32)
            cell = angles.argmin(1)
            band = np.clip((angles[np.arange(len(v)), cell] * (BANDS / np.pi)).astype(np.int32), 0, BANDS - 1)
            lists = [
                pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1]).astype(np.int32) if m.shape[1] else np.zeros(len(m) + 1, np.int32), pa.array(m.ravel()))
                for m in (v, angles)
            ]
            arrays = [*(batch.column(c) for c in ("row", "id", "label", "anchor")), lists[0], pa.array(norms), lists[1], pa.array(cell.astype(np.int32)), pa.array(band)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "label", "anchor", "v", "norm", "angles", "cell", "band"])

    return rows.mapInArrow(work, _INDEX)


def _references(rows: DataFrame) -> np.ndarray:
    """Directions chosen from at most ``SAMPLE`` rows, by a hash; the thinned rows are bounded before they meet."""
    total = rows.count()
    draw = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    thinned = rows.where(draw < min(1 << 30, int((1 << 30) * (3 * SAMPLE + 200) / max(total, 1)) + 1))
    sample = thinned.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").toArrow().column("v")
    return spread_directions(_floors(sample), REFERENCES)


@dataclass(frozen=True)
class Index:
    """Vectors with angles, in a written table, by ``slice`` and ``chunk``; and the slices."""

    rows: DataFrame
    slices: Slices
    groups: int

    def visits(self, anchors: DataFrame, own: bool) -> DataFrame:
        """A row for each anchor and chunk to search: of its own slice, or of others that a window meets.

        Windows are ``low`` to ``high``; a slice none of whose scores can lie there is left out.
        """
        slices = self.slices

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                angles = matrix(batch.column("angles"))
                norms, low, high, home = (batch.column(c).to_numpy() for c in ("norm", "low", "high", "slice"))
                at, to = [], []
                for i in range(len(batch)):
                    if own:
                        hit = home[i : i + 1]
                    else:
                        bounds = score_bounds(norms[i], slices.norm_low, slices.norm_high, *angle_bounds(angles[i].astype(float), slices.angle_low, slices.angle_high))
                        hit = np.flatnonzero((bounds[1] >= low[i]) & (bounds[0] <= high[i]))
                        hit = hit[hit != home[i]]
                    at.append(np.full(len(hit), i))
                    to.append(hit)
                at, to = np.concatenate([np.zeros(0, int), *at]), np.concatenate([np.zeros(0, int), *to])
                held = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(to.astype(np.int32)), pa.array(slices.chunks[to].astype(np.int32))], names=[*held.schema.names, "to", "chunks"])

        schema = T.StructType([*anchors.schema.fields, *T.StructType.fromDDL("to int, chunks int").fields])
        found = anchors.mapInArrow(work, schema)
        chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        return found.select(*[c for c in anchors.columns if c != "slice"], F.col("to").alias("slice"), chunk)

    def search(self, visits: DataFrame, task, schema: str) -> DataFrame:
        """The rows of ``task(anchors, vectors)`` for every chunk and group of anchors that visit it."""
        keys = ["slice", "chunk", "group"]
        vectors = self.rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        visits = visits.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(self.groups)).cast("int"))
        arrow = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in T.StructType.fromDDL(schema)])

        def scored(anchors: pa.Table, rows: pa.Table) -> pa.Table:
            out = []
            if len(anchors) and len(rows):
                width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (anchors, rows))
                vectors = _Vectors(rows, width)
                points = matrix(anchors.column("v"), width)
                for i, anchor in enumerate(anchors.drop_columns(["v"]).to_pylist()):
                    out += task(anchor, points[i], vectors)
            columns = list(zip(*out, strict=True)) or [[] for _ in arrow]
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return visits.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(scored, schema)


class _Vectors:
    """The vectors of a chunk, by label and id."""

    def __init__(self, rows: pa.Table, width: int):
        ids, labels, numbers = (rows.column(c).to_numpy() for c in ("id", "label", "row"))
        order = np.lexsort((numbers, ids, labels))
        self.ids, self.labels, self.rows = ids[order], labels[order], numbers[order]
        self.v = matrix(rows.column("v"), width)[order]
        self.norms = rows.column("norm").to_numpy()[order]
        self.angles = matrix(rows.column("angles"))[order].astype(float)

    def label_range(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())

    def bounds(self, anchor: dict, at: slice) -> tuple[np.ndarray, np.ndarray]:
        angles, norms = self.angles[at], self.norms[at]
        return score_bounds(anchor["norm"], norms, norms, *angle_bounds(np.array(anchor["angles"], np.float32).astype(float), angles, angles))

    def best(self, at: np.ndarray, scores: np.ndarray, count: int) -> list[tuple[int, int, int]]:
        """Id, row and score of the highest scores, ties by id and row."""
        if len(at) > count:
            kept = scores >= np.partition(scores, len(scores) - count)[len(scores) - count]
            at, scores = at[kept], scores[kept]
        order = np.lexsort((self.rows[at], self.ids[at], ~scores))[:count]
        return list(zip(self.ids[at[order]].tolist(), self.rows[at[order]].tolist(), scores[order].tolist(), strict=True))


def _first(found: DataFrame, by: list[str], count: int, name: str) -> DataFrame:
    """The ``count`` best rows of each group of ``by``, numbered from 1."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "of")
    return found.withColumn(name, F.row_number().over(best)).where(F.col(name) <= count)


def build_index(rows: DataFrame, scale: float) -> Index | None:
    """The index of ``row, id, label, anchor, vector``; nothing where no row takes part."""
    bound_batches(rows.sparkSession)
    rows = _taking_part(rows, scale)
    references = _references(rows)
    placed = materialize(_indexed(rows, references), "angles")
    count = len(references)
    angle = [F.col("angles")[j] for j in range(count)]
    stats = placed.groupBy("cell", "band").agg(
        F.count("*").alias("n"), F.min("norm").alias("norm_low"), F.max("norm").alias("norm_high"),
        *[F.min(angle[j]).alias(f"low_{j}") for j in range(count)], *[F.max(angle[j]).alias(f"high_{j}") for j in range(count)],
    ).collect()  # fmt: skip  # REFERENCES times BANDS rows at most
    if not stats:
        return None
    slices = cut_slices(stats, count)
    spark = placed.sparkSession
    cuts = [(int(c), int(b), int(s), int(slices.chunks[s])) for (c, b), s in np.ndenumerate(slices.number) if s >= 0]
    cuts = spark.createDataFrame(cuts, "cell int, band int, slice int, chunks int")
    dealt = F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")
    placed = placed.join(F.broadcast(cuts), ["cell", "band"]).withColumn("chunk", dealt).drop("cell", "band", "chunks")
    anchors = placed.where("anchor").count()
    return Index(placed, slices, max(1, math.ceil(anchors / ANCHORS)))


def hard_negatives(
    embeddings: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    label: Column | str = "label",
    vector: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """Rows of another label whose score lies in a window below a positive's.

    A vector's components become ``floor(scale * x)``; scores are integer inner products.
    The positives of an anchor are its first ``positives`` other rows of the same label, and
    of each the first ``negatives`` rows of another label are returned whose score is from
    ``window[0]`` to ``window[1]`` hundredths of the positive's. Higher scores come first,
    then smaller keys; all, if there are fewer.

    Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``
    and ``negative_score``. Rows without key, label or vector, or with a null or non-finite
    component, take no part. Repeated rows are rows each, and so are repeated anchors.
    Shorter vectors count as filled with zeros; components are held within 2^62, and scores
    within 64 bits. An empty table gives no rows; other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    spark = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build_index(
        embeddings.select(
            scan_row().alias("row"), F.col(key).cast("long").alias("id"), label.alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
            F.col(vector).cast("array<double>").alias("vector"),
        ), scale,
    )
    if index is None:
        return spark.createDataFrame([], schema)
    chosen = index.rows.where("anchor").select("row", "id", "label", "v", "norm", "angles", "slice")

    def near(anchor: dict, point: np.ndarray, vectors: _Vectors) -> list[tuple]:
        first, last = vectors.label_range(anchor["label"])
        _, high = vectors.bounds(anchor, slice(first, last))
        at = first + np.flatnonzero(high >= anchor["low"])
        at = at[vectors.rows[at] != anchor["row"]]
        scores = integer_scores(point, vectors.v[at])
        return [(anchor["row"], anchor["id"], *x) for x in vectors.best(at, scores, positives)]

    found = "row long, anchor_id long, id long, of long, score long"
    open_ended = [F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")]
    own = materialize(index.search(index.visits(chosen.select("*", *open_ended), True), near, found), "own-positives")
    least = own.groupBy("row").agg(F.when(F.count("*") >= positives, F.try_element_at(F.sort_array(F.collect_list("score"), False), F.lit(positives))).alias("low"))
    narrowed = chosen.join(least, "row", "left").select(*chosen.columns, F.coalesce(F.col("low").cast("double"), open_ended[0]).alias("low"), open_ended[1])
    other = index.search(index.visits(narrowed, False), near, found)
    pairs = materialize(_first(own.unionByName(other), ["row"], positives, "place").drop("place"), "positives")

    # Windows as whole numbers; with a score below 0 there is none.
    low, high = (F.col("score").cast("decimal(38,0)") * w for w in window)
    windows = pairs.select(
        "row", F.struct(F.col("of").alias("of"), F.col("id").alias("id"), F.col("score").alias("score"),
        F.ceil(low / 100).cast("long").alias("low"), F.floor(high / 100).cast("long").alias("high")).alias("window"),
    ).where("window.low <= window.high")

    def far(anchor: dict, point: np.ndarray, vectors: _Vectors) -> list[tuple]:
        first, last = vectors.label_range(anchor["label"])
        low, high = vectors.bounds(anchor, slice(None))
        met = np.zeros(len(low), bool)
        for w in anchor["windows"]:
            met |= (high >= w["low"]) & (low <= w["high"])
        met[first:last] = False
        at = np.flatnonzero(met)
        scores = integer_scores(point, vectors.v[at])
        out = []
        for w in anchor["windows"]:
            inside = (scores >= w["low"]) & (scores <= w["high"])
            best = vectors.best(at[inside], scores[inside], negatives)
            out += [(anchor["row"], anchor["id"], w["of"], w["id"], w["score"], *x) for x in best]
        return out

    found = "row long, anchor_id long, positive long, positive_id long, positive_score long, id long, of long, score long"

    def with_windows(windows: DataFrame) -> DataFrame:
        held = windows.groupBy("row").agg(F.collect_list("window").alias("windows"), F.min("window.low").cast("double").alias("low"), F.max("window.high").cast("double").alias("high"))
        return chosen.join(held, "row")

    own = materialize(index.search(index.visits(with_windows(windows), True), far, found), "own-negatives")
    tenth = own.groupBy("row", F.col("positive").alias("of")).agg(
        F.when(F.count("*") >= negatives, F.try_element_at(F.sort_array(F.collect_list("score"), False), F.lit(negatives))).alias("tenth")
    )
    raised = windows.select("row", "window.*").join(tenth, ["row", "of"], "left").withColumn("low", F.greatest("low", "tenth"))
    raised = raised.select("row", F.struct("of", "id", "score", "low", "high").alias("window"))
    other = index.search(index.visits(with_windows(raised), False), far, found)
    best = _first(own.unionByName(other), ["row", "positive"], negatives, "rank")
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
