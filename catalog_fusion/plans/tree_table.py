"""Boosted trees as a table of nodes, and scoring by that table alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "tree int, weight double, node int, feature int, threshold double, below int, above int, prediction double"

_TREE = re.compile(r"\s*Tree (\d+) \(weight (\S+)\):")
_SPLIT = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


def tree_nodes(spark: SparkSession, trees: GBTRegressionModel) -> DataFrame:
    """A row for each node of each tree: its feature and threshold, and the nodes below it and above it.

    A leaf has a prediction instead. Values up to the threshold go below. The number of
    rows is bounded by rounds and depth of the model, not by the data.
    """
    lines = iter(trees.toDebugString.splitlines()[1:])
    rows: list[tuple] = []
    for line in lines:
        if line.strip():
            number, weight = _TREE.match(line).groups()
            nodes: list[tuple] = []
            _read(lines, nodes)
            rows += [(int(number), float(weight), *n) for n in nodes]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def _read(lines: Iterator[str], nodes: list[tuple]) -> int:
    """Add the next node and what is under it; its number."""
    line, number = next(lines), len(nodes)
    nodes.append(())
    if leaf := _LEAF.match(line):
        nodes[number] = (number, None, None, None, None, float(leaf[1]))
        return number
    feature, threshold = _SPLIT.match(line).groups()
    below = _read(lines, nodes)
    next(lines)  # the other side of the split
    nodes[number] = (number, int(feature), float(threshold), below, _read(lines, nodes), None)
    return number


def score_nodes(rows: DataFrame, nodes: DataFrame, features: Column, depth: int, name: str = "prediction") -> DataFrame:
    """``rows`` with the weighted sum of the trees' predictions, from an array of ``features``.

    Every tree is descended up to ``depth`` steps, for a batch of rows at a time, so nothing is
    joined or shuffled; the table of nodes, bounded by the model, travels with the function.
    An unknown feature or threshold goes above, as does a comparison with null.
    """
    trees: dict[tuple, list] = {}
    for n in nodes.collect():
        trees.setdefault((n["tree"], n["weight"]), []).append(n)
    order = sorted(trees, key=lambda t: [(v is not None, v or 0) for v in t])
    forest = [(weight, *_arrays(sorted(trees[tree, weight], key=lambda n: n["node"]))) for tree, weight in order]
    width = 1 + max((int(feature.max()) for _, feature, *_ in forest), default=-1)

    # A local function travels by value, so workers need not have this package.
    @F.arrow_udf("double")
    def score(held: pa.Array) -> pa.Array:
        ends, known = held.offsets.to_numpy(), held.is_valid().to_numpy(zero_copy_only=False)
        if known.any() and np.diff(ends)[known].min() < width:
            raise ValueError(f"rows need {width} features")
        at = np.arange(width)[:, None] + ends[:-1][known]
        cells, void = np.full((width, len(held)), np.nan), np.ones((width, len(held)), bool)
        cells[:, known] = held.values.to_numpy(zero_copy_only=False)[at]
        void[:, known] = held.values.is_null().to_numpy(zero_copy_only=False)[at]
        cells, void = cells.ravel(), void.ravel()
        row, total, unknown = np.arange(len(held)), np.zeros(len(held)), np.zeros(len(held), bool)
        for weight, feature, threshold, last, below, above, prediction, blank in forest:
            node, start, has_last = np.zeros(len(held), np.int64), feature * len(held), last.any()
            for _ in range(depth):
                cell = start.take(node) + row
                goes = cells.take(cell) <= threshold.take(node)
                if has_last:  # NaN is above all numbers
                    goes |= last.take(node) & ~void.take(cell)
                node = np.where(goes, below.take(node), above.take(node))
            unknown |= blank[node] | (weight is None)
            total += (weight or 0.0) * prediction[node]
        return pa.array(total, mask=unknown)

    return rows.withColumn(name, score(features.cast("array<double>")))


def _arrays(nodes: list) -> tuple[np.ndarray, ...]:
    """One tree as arrays by node: feature, threshold, whether that is NaN, below, above, prediction, whether that is null.

    A leaf leads to itself, and a node without threshold above.
    """
    leaf = [n["feature"] is None for n in nodes]
    above = [i if leaf[i] else n["above"] for i, n in enumerate(nodes)]
    below = [i if leaf[i] else n["above"] if n["threshold"] is None else n["below"] for i, n in enumerate(nodes)]
    threshold = np.array([np.inf if n["threshold"] is None else n["threshold"] for n in nodes], float)
    prediction = [n["prediction"] for n in nodes]
    return (
        np.array([n["feature"] or 0 for n in nodes]),
        threshold,
        np.isnan(threshold),
        np.array(below),
        np.array(above),
        np.array([0.0 if p is None else p for p in prediction], float),
        np.array([p is None for p in prediction]),
    )
