"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's path, and the
least draw wins, so that children receive rows in proportion to their weights. A
child's draw depends on nothing but the key, its own path and its own weight: a
changed weight moves rows between that child and its siblings only, and a subtree
whose path to the root keeps its weights keeps its rows. A shard added as a region
of its own thus only takes rows, and only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog_fusion.llm.tables import scan_row
from catalog_fusion.scratch import materialize

_LEVELS = ("region", "rack")


@dataclass(frozen=True)
class Leaf:
    """One shard and its place in the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, fan_out: int = 2) -> list[Leaf]:
    """``shards`` equal leaves, ``fan_out`` to a rack and ``fan_out`` racks to a region."""
    per_region = fan_out * fan_out
    return [Leaf(f"region{i // per_region}", f"rack{i // fan_out % fan_out}", i) for i in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    new = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"region+{new}", "rack0", new, weight)]


def _draw(key: Column, path: str, children: dict[str, float]) -> Column:
    """Name of the child that wins at the node ``path``."""
    draws = []
    for name, weight in sorted(children.items()):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}/{name}")), 11)
        uniform = (bits.cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.ln(uniform) / weight).alias("draw"), F.lit(name).alias("name")))
    if len(draws) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*draws))["name"]


def _children(tree: Sequence[Leaf], path: tuple[str, ...]) -> dict[str, float]:
    out: dict[str, float] = {}
    for leaf in tree:
        place = (leaf.region, leaf.rack, str(leaf.shard))
        if place[: len(path)] == path and leaf.weight > 0:
            out[place[len(path)]] = out.get(place[len(path)], 0.0) + leaf.weight
    return out


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard that ``key`` descends to.

    A null key is a key of its own. Shards of weight zero receive nothing.
    """
    if not any(leaf.weight > 0 for leaf in tree):
        raise ValueError("a shard tree needs a leaf with a positive weight")

    def descend(path: tuple[str, ...]) -> Column:
        children = _children(tree, path)
        winner = _draw(key, "/".join(path), children)
        if len(path) == len(_LEVELS):
            return winner.cast("int")
        out = None
        for name in sorted(children)[1:]:
            below = descend((*path, name))
            out = F.when(winner == name, below) if out is None else out.when(winner == name, below)
        first = descend((*path, min(children)))
        return first if out is None else out.otherwise(first)

    return descend(())


def shard_rows(
    documents: DataFrame, tree: Sequence[Leaf], larger: Sequence[Leaf] | None = None, key: str = "doc_id"
) -> DataFrame:
    """Shard, slot and size of every row.

    Returns ``key``, ``size`` (UTF-8 bytes plus one), ``text_crc32``, ``shard``,
    ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (the shard in
    ``larger``, null without one). A null text has no bytes. Rows with equal keys
    share a shard and keep a slot each; an empty table gives an empty result. Other columns
    are not read.

    Slots come from one count for each shard and scan split, so that no shard is
    ever numbered in one task, however many rows or copies of a key it holds.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = materialize(
        documents.select(
            F.col(key).alias(key),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            shard_of(F.col(key), tree).alias("shard"),
            (shard_of(F.col(key), larger) if larger else F.lit(None).cast("int")).alias("grown_shard"),
            scan_row().alias("row"),
        ),
        "shards",
    ).withColumn("split", F.shiftright("row", 33))
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        place.groupBy("shard", "split")
        .agg(F.count("*").alias("rows"))
        .select("shard", "split", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "split").orderBy("row")
    numbered = place.withColumn("within", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "split"]).select(
        key, "size", "text_crc32", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), "grown_shard"
    )
