"""Exact top-k inner products by best-first search of a distributed M-tree.

Vectors get one more coordinate that brings them all to the same norm ``M``, queries get
a 0 there. Then ``distance² = |q|² + M² - 2 q.v``, so the largest inner products are the
nearest points of a metric space, and the triangle inequality holds.

The root holds the pivots, each with the radius that covers its vectors. A node with more
vectors than a page holds is split: routing vectors far apart are chosen from some of its
own, its vectors go to the nearest of them, and each of these is a node with its own radius
and its distance from the node above. So the tree is as deep as the vectors need. Below
each last node is a page of bounded size, one row of the page table (equal vectors, which
can not be told apart, fill several). A page again holds nodes: a routing vector, its
covering radius, and its distance from the page's; and for every entry of a node the
distance from the routing vector. Searches descend level by level. Pages and their nodes
are searched nearest bound first, and stored distances rule out nodes and entries before
their distance from the query is computed.

Every row is in the tree; only the routing vectors come from samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog_fusion.llm.tables import bound_batches, by_keys, scan_row
from catalog_fusion.scratch import materialize

#: Vectors for each pivot, most pivots, and sampled vectors for each to choose from.
PER_PIVOT, PIVOTS, CHOICE = 2048, 256, 8
#: Routing vectors of a node that is split, and levels of such nodes at most.
FAN, LEVELS = 16, 12
#: Entries of a page and (on average) of a node, and queries that search a page in one task.
PAGE, NODE, QUERIES = 4096, 64, 2048
#: Routing vectors of a level that may be broadcast, in bytes.
ROUTING_BYTES = 32 << 20
#: Up to here floating-point sums of products are exact.
_EXACT = float(1 << 53)
#: Stands for a null number.
NONE = -(1 << 63)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as floats, as 64-bit integers."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = np.abs(queries).max() * np.abs(vectors).max() * vectors.shape[1]
    if bound < _EXACT:
        return np.rint(queries @ vectors.T).astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for v in vectors] for q in queries]
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, x)) for x in row] for row in whole], np.int64)


def lifted(vectors: np.ndarray, square: float) -> np.ndarray:
    """The vectors with the coordinate that makes their squared norm ``square``."""
    rest = np.sqrt(np.maximum(square - (vectors * vectors).sum(1), 0.0))
    return np.concatenate((vectors, rest[:, None]), 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def spread_out(vectors: np.ndarray, count: int) -> np.ndarray:
    """Places of up to ``count`` vectors, each the farthest from those before it."""
    chosen = [0]
    nearest = distances(vectors[:1], vectors)[0]
    while len(chosen) < min(count, len(vectors)):
        far = int(nearest.argmax())
        if nearest[far] <= 0:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, distances(vectors[far : far + 1], vectors)[0])
    return np.array(chosen)


class Page:
    """A page: its pivot's vectors, or a part of them, in nodes."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivot: np.ndarray, square: float):
        points = lifted(vectors, square)
        routers = spread_out(points, math.ceil(len(points) / NODE))
        away = distances(points, points[routers])
        node = away.argmin(1)
        order = np.argsort(node, kind="stable")
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        node = node[order]
        self.starts = np.searchsorted(node, np.arange(len(routers) + 1))
        #: Of each entry from its routing vector, of each of those from the pivot.
        self.entry_away = away[order, node]
        self.routers = vectors[routers]
        self.parent_away = distances(points[routers], lifted(pivot[None, :], square))[:, 0]
        self.radius = np.array([self.entry_away[a:b].max(initial=0.0) for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)])

    def search(
        self, query: np.ndarray, own: int, pivot_away: float, square: float, k: int, least: int | None
    ) -> tuple[list[tuple[int, int, int]], int]:
        """The best ``(score, id, row)`` but for row ``own``, and the number of distances computed.

        ``least`` is a score that ``k`` others reach; lower ones may be left out.
        """
        norm = float(query @ query) + square
        slack = 1e-6 * math.sqrt(norm) + 1e-9
        reach = math.inf if least is None else math.sqrt(max(norm - 2.0 * least, 0.0)) + slack
        near = np.flatnonzero(np.abs(pivot_away - self.parent_away) - self.radius <= reach)
        computed = len(near)
        router_away = np.sqrt(np.maximum(norm - 2.0 * (self.routers[near] @ query), 0.0))
        bound = np.maximum(router_away - self.radius[near], 0.0)
        best: list[tuple[int, int, int]] = []
        for i in np.argsort(bound, kind="stable"):
            if bound[i] > reach:
                break
            low, high = self.starts[near[i]], self.starts[near[i] + 1]
            at = low + np.flatnonzero(np.abs(router_away[i] - self.entry_away[low:high]) <= reach)
            at = at[self.rows[at] != own]
            computed += len(at)
            scores = products(query[None, :], self.vectors[at])[0]
            if least is not None:
                at, scores = at[scores >= least], scores[scores >= least]
            best += zip((-scores).tolist(), self.ids[at].tolist(), self.rows[at].tolist(), strict=True)
            if len(best) > k or (best and least is None):
                best = sorted(best)[:k]
                if len(best) == k:
                    least = -best[-1][0]
                    reach = math.sqrt(max(norm - 2.0 * least, 0.0)) + slack
        return [(-s, i, r) for s, i, r in sorted(best)[:k]], computed

    def pack(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(value).tobytes() for name, value in self.__dict__.items()}

    @classmethod
    def unpack(cls, held: dict[str, bytes], width: int) -> Page:
        page = cls.__new__(cls)
        for name, data in held.items():
            kind = np.int64 if name in ("rows", "ids", "starts") else np.float64
            value = np.frombuffer(data, kind)
            setattr(page, name, value.reshape(-1, width) if name in ("vectors", "routers") else value)
        return page


def _child(node: int, number: int) -> int:
    """The number of a node's child: its level, above the way to it."""
    level, way = node >> 56, node & ((1 << 56) - 1)
    return (level + 1) << 56 | way << 4 | number


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _split_nodes(dealt: DataFrame, routers: DataFrame, width: int, square: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Leaves' rows, the leaves, and the inner nodes' children level by level.

    ``dealt`` has rows with their ``node`` and the distance ``away`` from its routing vector,
    ``routers`` those vectors. Rows are written once for each level that they are moved on.
    """
    fields = "row long, id long, asks boolean, node long, away double, packed binary"

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.frombuffer(b"".join(frame.sort_values("draw")["packed"]), np.float64).reshape(-1, width)
        own = np.frombuffer(frame["router"].iat[0], np.float64)[None, :]
        chosen = held[spread_out(lifted(held, square), FAN)]
        if len(chosen) < 2:  # nothing here tells them apart
            return pd.DataFrame([], columns=["node", "child", "router", "parent_away"])
        node, away = int(frame["node"].iat[0]), distances(lifted(chosen, square), lifted(own, square))[:, 0]
        return pd.DataFrame([(node, _child(node, i), c.tobytes(), a) for i, (c, a) in enumerate(zip(chosen, away, strict=True))], columns=["node", "child", "router", "parent_away"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, nodes = lifted(_unpacked(batch.column("packed"), width), square), batch.column("node").to_numpy()
            routing, to, away = batch.column("routing"), np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for node in np.unique(nodes):
                at = np.flatnonzero(nodes == node)
                apart = distances(points[at], lifted(np.frombuffer(routing[int(at[0])].as_py(), np.float64).reshape(-1, width), square))
                nearest = apart.argmin(1)
                to[at], away[at] = [_child(int(node), int(i)) for i in nearest], apart[np.arange(len(at)), nearest]
            kept = [batch.column(c) for c in ("row", "id", "asks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(to), pa.array(away), batch.column("packed")], names=["row", "id", "asks", "node", "away", "packed"])

    rows, leaves, levels = [], [], []
    for _ in range(LEVELS):
        sizes = dealt.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        known = materialize(sizes.join(routers, "node"), "nodes")
        large = known.where((F.col("n") > PAGE) & (F.col("radius") > 0)).select("node", "router")
        if large.isEmpty():
            rows.append(dealt)
            leaves.append(known)
            break
        drawn = by_keys(dealt, F.col("node"), large.select("node"), "left_semi").withColumn("draw", F.xxhash64("row"))
        place = F.row_number().over(Window.partitionBy("node").orderBy("draw", "row"))
        drawn = drawn.withColumn("place", place).where(F.col("place") <= CHOICE * FAN).join(large, "node")
        children = materialize(drawn.groupBy("node").applyInPandas(choose, "node long, child long, router binary, parent_away double"), "children")
        split = children.select("node").distinct()
        rows.append(by_keys(dealt, F.col("node"), split, "left_anti"))
        leaves.append(by_keys(known, F.col("node"), split, "left_anti"))
        if children.isEmpty():
            break
        routing = children.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "router"))), lambda c: F.hex(c["router"])), "").alias("routing"))
        routing = routing.select("node", F.unhex("routing").alias("routing"))
        side = F.broadcast(routing) if routing.count() * FAN * width * 8 <= ROUTING_BYTES else routing
        moving = by_keys(dealt, F.col("node"), split, "left_semi").join(side, "node")
        dealt = materialize(moving.mapInArrow(move, fields), "moved")
        reach = dealt.groupBy(F.col("node").alias("child")).agg(F.max("away").alias("radius"))
        levels.append(materialize(children.join(reach, "child"), "level"))
        routers = children.select(F.col("child").alias("node"), "router")
    else:
        known = dealt.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("radius")).join(routers, "node")
        rows.append(dealt)
        leaves.append(known)
    return reduce(DataFrame.unionByName, rows), materialize(reduce(DataFrame.unionByName, leaves), "leaves"), levels


_PAGE_FIELDS = ("rows", "ids", "vectors", "starts", "entry_away", "routers", "parent_away", "radius")


def _packed(values: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as floats, padded with zeros."""
    out = np.zeros((len(values), width))
    lengths = np.array([len(v) for v in values], np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.repeat(np.arange(len(values)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", computed: Accumulator | None = None) -> DataFrame:
    """The ``k`` largest inner products of each query with all other rows.

    Components are ``floor(scale * x)``. Returns ``query_id``, ``rank`` (from 1), ``key`` and
    ``score``; ties go to the smaller id. Rows whose vector is null, or holds null or
    non-finite components, take no part. Shorter vectors count as padded with zeros, an
    empty one as zeros. Rows with a repeated id are rows of their own, and a query only
    leaves out its own row. A null id comes first among ties. Queries with fewer other
    rows get all; an empty table gives no rows. Scores beyond 64 bits stop at their limits.
    ``computed`` counts the distances that the search of pages computes.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    rows = vectors.where(F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("vector")
    )
    rows = materialize(rows.withColumn("row", scan_row()), "vectors")
    square_of = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    total, width, square, asking = rows.agg(
        F.count("*"), F.max(F.size("vector")), F.max(square_of), F.count_if("asks")
    ).first()
    result = "query_row long, query_id long, id long, row long, score long"
    if not total or not asking:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    width = max(1, width)
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(CHOICE * min(PIVOTS, math.ceil(total / PER_PIVOT)))
    drawn = drawn.select("row", "vector").toArrow()
    sample_rows, sample = drawn.column("row").to_numpy(), _packed(drawn.column("vector").combine_chunks(), width)
    pivots = sample[spread_out(lifted(sample, square), min(PIVOTS, math.ceil(total / PER_PIVOT)))]
    roots = lifted(pivots, square)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = _packed(batch.column(3), width)
            away = distances(lifted(packed, square), roots)
            nearest = away.argmin(1)
            columns = [pa.array(nearest), pa.array(away[np.arange(len(away)), nearest]), pa.array([v.tobytes() for v in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["row", "id", "asks", "node", "away", "packed"])

    dealt = materialize(
        rows.select("row", "id", "asks", "vector").mapInArrow(assign, "row long, id long, asks boolean, node long, away double, packed binary"), "dealt"
    )
    # One row for each pivot.
    root = {r["node"]: r["away"] for r in dealt.groupBy("node").agg(F.max("away").alias("away")).collect()}
    routers = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(pivots)], "node long, router binary")
    entries, leaves, levels = _split_nodes(dealt, routers, width, square)
    leaves = leaves.withColumn("parts", F.ceil(F.col("n") / PAGE))

    def build(_: tuple, frame: pd.DataFrame, leaf: pd.DataFrame) -> pd.DataFrame:
        held = np.frombuffer(b"".join(frame["packed"]), np.float64).reshape(-1, width)
        router = np.frombuffer(leaf["router"].iat[0], np.float64)
        page = Page(frame["row"].to_numpy(np.int64), frame["id"].to_numpy(np.int64), held, router, square).pack()
        return pd.DataFrame([{"node": int(leaf["node"].iat[0]), "part": int(leaf["part"].iat[0]), **page}])

    many = leaves.where("parts > 1").select("node", "parts")  # of equal vectors only, or nearly
    entries = entries.join(many, "node", "left").withColumn("part", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))
    entries = materialize(entries.drop("parts"), "entries")
    stored = entries.select("row", F.coalesce("id", F.lit(NONE)).alias("id"), "node", "part", "packed")
    places = leaves.select("node", "router", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    places = places.join(stored.select("node", "part").distinct(), ["node", "part"], "left_semi")
    fields = ", ".join(f"{name} binary" for name in _PAGE_FIELDS)
    pages = stored.groupBy("node", "part").cogroup(places.groupBy("node", "part")).applyInPandas(build, f"node long, part long, {fields}")
    pages = materialize(pages, "pages")

    blocks = math.ceil(asking / QUERIES)
    queries = entries.where("asks").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    asked = "row long, id long, packed binary, block long, home long, least long"

    def reach_of(held: np.ndarray, least: int | None) -> float:
        norm = float(held @ held) + square
        return math.inf if least is None else math.sqrt(max(norm - 2.0 * least, 0.0)) + 1e-6 * math.sqrt(norm) + 1e-9

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the score that ``k`` sampled rows reach."""
        for batch in batches:
            held = _unpacked(batch.column("packed"), width)
            scores = products(held, sample).astype(object)
            scores[batch.column("row").to_numpy()[:, None] == sample_rows[None, :]] = None
            seen = [sorted((x for x in row if x is not None), reverse=True) for row in scores]
            least = pa.array([x[k - 1] if len(x) >= k else None for x in seen], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "packed", "block", "home")), least], names=["row", "id", "packed", "block", "home", "least"])

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their distance from the routing vector of their own leaf."""
        for batch in batches:
            if len(batch):
                held = _unpacked(batch.column("packed"), width)
                gaps = np.concatenate((held, np.zeros((len(held), 1))), 1) - lifted(_unpacked(batch.column("router"), width), square)
                kept = [batch.column(c) for c in ("row", "id", "packed", "block", "home", "least", "node", "part")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.sqrt((gaps * gaps).sum(1)))], names=["row", "id", "packed", "block", "home", "least", "node", "part", "away"])

    def from_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries and the pivots within reach."""
        numbers = np.array(sorted(root))
        radius = np.array([root[p] for p in numbers])
        for batch in batches:
            held = _unpacked(batch.column("packed"), width)
            away = distances(np.concatenate((held, np.zeros((len(held), 1))), 1), roots[numbers])
            reach = np.array([reach_of(q, x) for q, x in zip(held, batch.column("least").to_pylist(), strict=True)])
            at, to = np.nonzero(away - radius <= reach[:, None])
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers[to]), pa.array(away[at, to])], names=[*taken.schema.names, "node", "away"])

    def descend(_: tuple, queries: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        """Queries at a node and its children within reach; stored distances rule out some unseen."""
        out = []
        if len(queries) and len(below):
            routing = lifted(np.frombuffer(b"".join(below["router"]), np.float64).reshape(-1, width), square)
            children, radius, parent_away = (below[c].to_numpy() for c in ("child", "radius", "parent_away"))
            for row in queries.itertuples(index=False):
                held = np.frombuffer(row.packed, np.float64)
                reach = reach_of(held, None if row.least == NONE else row.least)
                near = np.flatnonzero(np.abs(row.away - parent_away) - radius <= reach)
                away = distances(np.concatenate((held, [0.0]))[None, :], routing[near])[0]
                for j in np.flatnonzero(away - radius[near] <= reach):
                    out.append((row.row, row.id, row.packed, row.block, row.home, row.least, int(children[near[j]]), float(away[j])))
        return pd.DataFrame(out, columns=["row", "id", "packed", "block", "home", "least", "node", "away"])

    def search(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(stored):
            page = Page.unpack({name: stored[name].iat[0] for name in _PAGE_FIELDS}, width)
            for row, number, packed, away, least in zip(*(asked[c] for c in ("row", "id", "packed", "away", "least")), strict=True):
                best, count = page.search(np.frombuffer(packed, np.float64), row, away, square, k, None if least == NONE else least)
                if computed is not None:
                    computed.add(count)
                out += [(row, number, i, r, s) for s, i, r in best]
        return pd.DataFrame(out, columns=["query_row", "query_id", "id", "row", "score"])

    def meeting(wanted: DataFrame, stored: DataFrame, place: list[str]) -> DataFrame:
        """What is ``stored`` at a place, for every block of queries that comes there."""
        return stored.join(wanted.select(*place, F.col("block").alias("met")).distinct(), place)

    # Pandas has no integers with nulls.
    filled = F.coalesce("least", F.lit(NONE)).alias("least")

    def searched(visits: DataFrame) -> DataFrame:
        """The best of every page visited: rows have a query, a leaf, its part and how far it is."""
        place = ["node", "part"]
        wanted = materialize(visits.select("row", "id", "packed", "block", *place, "away", filled), "visits")
        met = meeting(wanted, pages, place)
        return wanted.groupBy(*place, "block").cogroup(met.groupBy(*place, "met")).applyInPandas(search, result)

    def descended(asking_rows: DataFrame) -> DataFrame:
        """Visits of all leaves within reach, but for the page of the query itself."""
        frontier = asking_rows.mapInArrow(from_root, f"{asked}, node long, away double").withColumn("least", filled)
        found = []
        for children in levels:
            frontier = materialize(frontier, "frontier")
            inner = children.select("node").distinct()
            found.append(by_keys(frontier, F.col("node"), inner, "left_anti"))
            inside = by_keys(frontier, F.col("node"), inner, "left_semi")
            met = meeting(inside, children, ["node"])
            frontier = inside.groupBy("node", "block").cogroup(met.groupBy("node", "met")).applyInPandas(descend, f"{asked}, node long, away double")
        at = reduce(DataFrame.unionByName, [*found, frontier]).join(leaves.select("node", "parts"), "node")
        visits = at.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return visits.where((F.col("node") != F.col("home")) | (F.col("part") != F.pmod(F.xxhash64("row"), F.col("parts")))).withColumn("least", F.nullif("least", F.lit(NONE)))

    known = queries.withColumn("id", F.coalesce("id", F.lit(NONE)))
    # A query's own page first: its row lies in it, so that it is at the stored distance from its routing vector.
    first = known.withColumn("home", F.col("node")).select("row", "id", "packed", "block", "home").mapInArrow(sampled, asked)
    lies = known.join(leaves.select("node", "router"), "node").select("row", "node", "part", "router")
    first = first.join(lies, "row").mapInArrow(at_home, f"{asked}, node long, part long, away double")
    first = materialize(first, "first")
    near = materialize(searched(first), "near")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row"))
    least = near.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("tenth"))
    reached = first.join(least, "row", "left").withColumn("least", F.greatest("least", "tenth"))
    far = searched(descended(reached.select("row", "id", "packed", "block", "home", "least")))
    best = near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k)
    shown = {c: F.when(F.col(c) != NONE, F.col(c)) for c in ("query_id", "id")}
    return best.select(shown["query_id"].alias("query_id"), "rank", shown["id"].alias(key), "score")
