import math
import zlib
from collections import Counter

import pytest
import xxhash

from catalog_fusion.llm.shard_tree import Leaf, balanced_tree, grown, shard_of, shard_rows

SCHEMA = "doc_id long, text string, shard string, row long, size int"


def rows_of(spark, values, tree=None):
    df = spark.createDataFrame([(i, t, "x", 7, 1) for i, t in values], SCHEMA).repartition(3)
    tree = tree or balanced_tree(8)
    return shard_rows(df, tree, grown(tree)).collect()


def test_slots_are_gapless_and_sizes_right(spark):
    values = [(i, "é" * (i % 5)) for i in range(500)] + [(7, "same")] * 200 + [(None, None), (None, ""), (None, None)]
    out = rows_of(spark, values)
    assert len(out) == len(values)
    for shard in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in values)
    assert texts == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert len({r["shard"] for r in out if r["doc_id"] == 7}) == 1
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 1


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_one_more_shard_takes_rows_only_into_itself(spark):
    out = rows_of(spark, [(i, "t") for i in range(6000)])
    moved = [r for r in out if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {8}
    assert 0.8 < len(moved) / (6000 / 9) < 1.2
    assert all(0.8 < n / 750 < 1.2 for n in Counter(r["shard"] for r in out).values())


def test_a_changed_weight_moves_rows_only_below_its_own_root(spark):
    """Racks of a region whose weights stay hold the rows that stay in the region."""
    tree = [Leaf("a", "r0", 0), Leaf("a", "r0", 1), Leaf("a", "r1", 2), Leaf("b", "r0", 3), Leaf("b", "r1", 4, 2.0)]
    heavier = [*tree[:3], Leaf("b", "r0", 3, 3.0), tree[4]]
    df = spark.range(20000)
    pairs = Counter(tuple(r) for r in df.select(shard_of(df["id"], tree), shard_of(df["id"], heavier)).collect())
    moves = {(x, y) for x, y in pairs if x != y}
    assert not {(x, y) for x, y in moves if x in (0, 1, 2) and y in (0, 1, 2)}
    assert not {(x, y) for x, y in moves if x == 3}, "the heavier shard gives nothing away"
    share = sum(n for (_, y), n in pairs.items() if y == 3) / 20000
    assert abs(share - 3 / 8) < 0.02


def test_weight_zero_gets_nothing_and_a_tree_needs_weight(spark):
    df = spark.range(500)
    tree = [Leaf("a", "r", 0), Leaf("a", "r", 1, 0.0), Leaf("b", "r", 2, 0.0)]
    assert {r[0] for r in df.select(shard_of(df["id"], tree)).collect()} == {0}
    with pytest.raises(ValueError, match="positive"):
        shard_of(df["id"], [Leaf("a", "r", 0, 0.0)])


def brute_force(key, tree):
    """The leaf that a key descends to, draw by draw."""

    def draw(path, weight):
        bits = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        uniform = ((xxhash.xxh64_intdigest(path.encode(), bits) >> 11) + 0.5) / 2**53
        return -math.log(uniform) / weight

    path, leaves = "", [leaf for leaf in tree if leaf.weight > 0]
    for level in ("region", "rack", "shard"):
        weights = Counter()
        for leaf in leaves:
            weights[str(getattr(leaf, level))] += leaf.weight
        best = min(weights, key=lambda name: (draw(f"{path}/{name}", weights[name]), name)) if len(weights) > 1 else next(iter(weights))
        leaves = [leaf for leaf in leaves if str(getattr(leaf, level)) == best]
        path = f"{path}/{best}" if path else best
    return leaves[0].shard


def test_draws_equal_brute_force(spark):
    uneven = [Leaf("a", "r", 0, 1.0), Leaf("a", "r", 1, 2.5), Leaf("a", "s", 2, 0.5), Leaf("b", "r", 3, 4.0), Leaf("b", "t", 4, 0.0), Leaf("c", "u", 5, 0.25)]
    keys = [None, 0, -1, 2**62, *range(1, 400)]
    for tree in (uneven, balanced_tree(8), grown(balanced_tree(8))):
        rows = spark.createDataFrame([(k,) for k in keys], "k long")
        got = rows.select("k", shard_of(rows["k"], tree).alias("shard")).collect()
        assert {r["k"]: r["shard"] for r in got} == {k: brute_force(k, tree) for k in keys}
