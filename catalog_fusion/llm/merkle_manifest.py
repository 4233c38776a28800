"""A Merkle tree over a dataset, whose parents keep the states of their hash.

Rows are leaves. The leaves of a group, in the order of their keys, are hashed by threes
up to the group's root, and the groups' roots likewise up to the dataset's. A parent's
hash reads its children one after the other, so the parent keeps a copy of its state from
before each child. A changed child resumes the state of its slot, with the child and the
siblings to its right only, and so does each parent above.

The tree lies in pages: a page is a subtree of ``LEVELS`` levels, one row of a table, and
the roots of the pages of one layer are the members of the pages above. No task holds more
than a page, however many rows a group has, and a path to the root crosses few layers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from catalog_fusion.llm.tables import bound_batches, scan_row
from catalog_fusion.scratch import materialize

#: Children of a parent, and what stands for a null value.
ARITY, NULL = 3, "-"
#: Levels of a page: it has 729 members at most.
LEVELS = 6
_PLACE_BITS = 33  # of monotonically_increasing_id, below the partition


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256, in hex, of the values as text, each behind its length in bytes; nulls as ``-``."""
    texts = [v.cast("string") for v in values]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit(NULL)) for t in texts]
    return F.sha2(F.concat(*framed), 256)


def levels_of(members: int, most: int = LEVELS) -> int:
    """Levels above the members of a page, of ``most`` levels, of a tree with so many of them."""
    levels, held = 0, 1
    while held < members and levels < most:
        levels, held = levels + 1, held * ARITY
    return levels


class Page:
    """A subtree in memory: its nodes by level, and the state before each of them in its parent."""

    def __init__(self, members: Sequence[bytes], levels: int):
        self.levels: list[tuple[list[bytes], list]] = []
        nodes = list(members)
        for _ in range(levels):
            states, parents = [], []
            for low in range(0, len(nodes), ARITY):
                state = hashlib.sha256()
                for child in nodes[low : low + ARITY]:
                    states.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.levels.append((nodes, states))
            nodes = parents
        self.root = nodes[0]

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """Those left and right of the path from member ``at``, level by level."""
        out = []
        for nodes, _ in self.levels:
            low = at - at % ARITY
            out.append((b"".join(nodes[low:at]), b"".join(nodes[at + 1 : low + ARITY])))
            at //= ARITY
        return out

    def fold(self, at: int, member: bytes) -> bytes:
        """The root with another member at ``at``."""
        for nodes, states in self.levels:
            state = states[at].copy()
            state.update(member)
            state.update(b"".join(nodes[at + 1 : at - at % ARITY + ARITY]))
            member, at = state.hexdigest().encode(), at // ARITY
        return member


class Path:
    """The way from a page's root to the root of the tree: the parents' states of that slot."""

    def __init__(self, left: Sequence[str], right: Sequence[str]):
        self.right = [r.encode() for r in right]
        self.siblings = b"".join(x.encode() + y for x, y in zip(left, self.right, strict=True))
        self.states = [hashlib.sha256(x.encode()) for x in left]

    def fold(self, member: bytes) -> bytes:
        for kept, right in zip(self.states, self.right, strict=True):
            state = kept.copy()
            state.update(member)
            state.update(right)
            member = state.hexdigest().encode()
        return member


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``at``, the place in the row's ``tree`` from 0, and ``n``, the tree's rows.

    One range shuffle; then the rows of a tree that lie in a partition are counted, one row
    for each two, so a tree that holds most of the table is dealt over many tasks.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("place", _PLACE_BITS))
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "tree", "part", F.sum("held").over(whole).alias("n"),
        (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("offset"),
    )
    return placed.join(runs, ["tree", "part"]).select("*", (F.col("place") + F.col("offset")).alias("at")).drop("place", "part", "offset")


def _paged(nodes: DataFrame, levels: int) -> DataFrame:
    """Pages of nodes ``tree, at, n, id, leaf, other``: ``tree, page, n, members, digest``."""
    member = F.struct("at", "id", "leaf", "other")
    pages = nodes.groupBy("tree", F.expr(f"at div {ARITY**levels}").alias("page"), "n").agg(F.array_sort(F.collect_list(member)).alias("members"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            leaves = lists.values.field("leaf")
            roots = []
            for i, n in enumerate(batch.column("n").to_pylist()):
                low, high = lists.offsets[i].as_py(), lists.offsets[i + 1].as_py()
                members = [x.encode() for x in leaves.slice(low, high - low).to_pylist()]
                roots.append(Page(members, levels_of(n, levels)).root.decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "digest"])

    return materialize(pages.mapInArrow(hashed, T.StructType([*pages.schema.fields, T.StructField("digest", T.StringType())])), "pages")


def _layers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Pages of all layers, the leaves' first, until each tree has one page."""
    layers, size, none = [_paged(nodes, levels)], ARITY**levels, F.lit(None).cast("string")
    while (layers[-1].agg(F.max("n")).first()[0] or 0) > size:
        above = F.expr(f"(n + {size - 1}) div {size}").alias("n")
        roots = layers[-1].select("tree", F.col("page").alias("at"), above, none.alias("id"), F.col("digest").alias("leaf"), none.alias("other"))
        layers.append(_paged(roots, levels))
    return layers


@dataclass(frozen=True)
class Manifest:
    """The pages of the groups' trees and of the tree of their roots, by layer, and the root."""

    groups: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    levels: int  # of a page

    def save(self, path: str) -> None:
        """Write the pages below ``path``, a folder for each layer."""
        for kind, layers in (("groups", self.groups), ("top", self.top)):
            for i, pages in enumerate(layers):
                pages.write.parquet(f"{path}/{kind}-{i}")


def build_manifest(rows: DataFrame, key: Column, group: Column, leaf: Column, other: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The tree over ``rows``: leaves by rising ``key`` in each ``group``, groups by rising text, nulls first.

    ``leaf`` is a digest in hex, and ``other`` one that stands for a changed row (null: it is
    as it was). Rows with one key are told by their leaf. An empty table has no root.
    """
    bound_batches(rows.sparkSession)
    # Null groups come first, and no group's name is null.
    tree = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    changed = F.lit(None).cast("string") if other is None else other
    leaves = rows.select(tree.alias("tree"), key.alias("id"), leaf.alias("leaf"), changed.alias("other"), scan_row().alias("row"))
    groups = _layers(_placed(leaves, ["id", "leaf", "row"]).drop("row"), levels)
    roots = groups[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("digest").alias("leaf"), F.lit(None).cast("string").alias("other"))
    top = _layers(_placed(roots, ["id"]), levels)
    last = top[-1].select("digest").first()
    return Manifest(groups, top, last and last["digest"], levels)


_PATH = "left array<string>, right array<string>, subroot string"


def _paths(pages: DataFrame, levels: int) -> DataFrame:
    """``tree, at, id, leaf`` of every member of pages with the path above them, and its own path."""
    schema = T.StructType([*[pages.schema[c] for c in ("tree",)], T.StructField("at", T.LongType()), *T.StructType.fromDDL("id string, leaf string, " + _PATH).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                page = Page([m["leaf"].encode() for m in row["members"]], levels_of(row["n"], levels))
                for i, m in enumerate(row["members"]):
                    own = page.siblings(i)
                    out.append({
                        "tree": row["tree"], "at": m["at"], "id": m["id"], "leaf": m["leaf"], "subroot": row["subroot"],
                        "left": [x.decode() for x, _ in own] + row["left"], "right": [y.decode() for _, y in own] + row["right"],
                    })
            yield pa.RecordBatch.from_pylist(out, schema=_arrow)

    text = pa.string()
    _arrow = pa.schema([("tree", text), ("at", pa.int64()), ("id", text), ("leaf", text), ("left", pa.list_(text)), ("right", pa.list_(text)), ("subroot", text)])
    return pages.mapInArrow(work, schema)


def _under(pages: DataFrame, above: DataFrame) -> DataFrame:
    """Pages with the path above each: ``above`` has one for each ``tree`` and page ``at``."""
    return pages.join(above.select("tree", F.col("at").alias("page"), "left", "right", "subroot"), ["tree", "page"])


def prove(manifest: Manifest) -> DataFrame:
    """Of every leaf: ``id``, ``leaf``, ``subroot``, ``proof_sha256`` and ``folded_root``.

    The proof is the siblings on the way to the root, level by level and left to right; its
    hash is given. ``folded_root`` is recomputed from the changed leaf, or the leaf itself
    where there is none, and the siblings as they were. An empty manifest gives no rows.
    """
    bound_batches(manifest.groups[0].sparkSession)
    levels = manifest.levels
    none = F.array().cast("array<string>")
    above = manifest.top[-1].select("tree", F.lit(0).cast("long").alias("at"), none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"))
    for pages in reversed(manifest.top):
        above = _paths(_under(pages, above), manifest.levels)
    # The members of the top are the groups' roots.
    above = above.select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("at"), "left", "right", F.col("leaf").alias("subroot"))
    for pages in reversed(manifest.groups[1:]):
        above = _paths(_under(pages, above), manifest.levels)
    pages = _under(manifest.groups[0], materialize(above, "paths"))
    kind = pages.schema["members"].dataType.elementType["id"]
    schema = T.StructType([T.StructField("id", kind.dataType), *T.StructType.fromDDL("leaf string, subroot string, proof_sha256 string, folded_root string").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                n, left, right, subroot = (batch.column(c)[r].as_py() for c in ("n", "left", "right", "subroot"))
                members = batch.column("members")[r].values
                leaves = [x.encode() for x in members.field("leaf").to_pylist()]
                page, path = Page(leaves, levels_of(n, levels)), Path(left, right)
                proofs, roots = [], []
                for i, other in enumerate(members.field("other").to_pylist()):
                    proof = hashlib.sha256(b"".join(x + y for x, y in page.siblings(i)))
                    proof.update(path.siblings)
                    proofs.append(proof.hexdigest())
                    roots.append(path.fold(page.fold(i, leaves[i] if other is None else other.encode())).decode())
                arrays = [members.field("id"), members.field("leaf"), pa.array([subroot] * len(leaves), pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return pages.mapInArrow(work, schema)


def verified_rows(
    documents: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "source", changed: dict[str, Column] | None = None, levels: int = LEVELS
) -> DataFrame:
    """Whether each row of ``documents``, as ``changed``, is the row of the manifest.

    The manifest is that of the rows as they are, of their ``fields``; ``changed`` gives
    columns another value. Returns ``doc_id`` (the values of ``key``), ``leaf``, ``subroot``,
    ``root``, ``proof_sha256``, ``folded_root`` and ``verified``. Rows with equal keys are
    leaves each; null keys come first, and nulls in fields differ from empty texts. Other
    columns are not read. An empty table gives no rows.
    """
    leaf = leaf_digest([documents[c] for c in fields])
    other = None
    if changed:
        differs = F.lit(False)
        for c, value in changed.items():
            differs = differs | ~documents[c].eqNullSafe(value)
        other = F.when(differs, leaf_digest([changed.get(c, documents[c]) for c in fields]))
    manifest = build_manifest(documents, documents[key], documents[group], leaf, other, levels)
    root = F.lit(manifest.root).cast("string")
    return prove(manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
