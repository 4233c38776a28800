"""Exact duplicates by deterministic block naming.

A text, without white space, is cut into blocks of a fixed size. The distinct blocks are
sorted and numbered; then the distinct pairs of adjacent numbers are, and so on, until
each document has one number. Equal numbers of one level stand for equal runs of blocks
and nothing else, so documents with the same last number, at the same level, are equal
texts: there is nothing to collide.

Blocks are looked up by a 64-bit hash, which only narrows the rows of the join: hashes
that two blocks share are told from the counted names, and their rows are joined by the
blocks themselves.

Keys with many rows, such as the first block of a third of all documents, are the
``HOTTEST`` of their level; their numbers are broadcast, and their rows are dealt out. So
no other key holds more than one row in ``HOTTEST``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_fusion.llm.tables import by_keys, scan_row, whole_text
from catalog_fusion.scratch import materialize

#: Bytes of a block.
BLOCK = 4096
#: Keys of a level whose rows are looked up by broadcast, and the rows they have at least.
HOTTEST, HOT_ROWS = 4096, 64
#: Fixed value: the white space that does not count.
WHITE_SPACE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, WHITE_SPACE, "")


def blocks_of(data: Column, size: int = BLOCK) -> Column:
    """Binary data in pieces of ``size`` bytes; empty data is one empty piece."""
    last = F.greatest(F.lit(0), F.octet_length(data) - 1)
    return F.transform(F.sequence(F.lit(0), F.floor(last / size).cast("int")), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def named(counted: DataFrame, order: list[str], label: str) -> DataFrame:
    """Distinct keys, in a written table, with an integer ``name`` above 0 each.

    The keys are dealt by hash and sorted; partition and place make the number. A task that
    runs again sorts the same keys, and the table is written before it is used.
    """
    return materialize(counted.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id() + 1), label)


def look_up(rows: DataFrame, names: DataFrame, keys: list[str], values: tuple[str, ...] = ("name",)) -> DataFrame:
    """``rows`` with the ``values`` of their ``keys``; ``names`` holds each key once, with its rows ``n``."""
    found = F.struct(*values)
    hot = names.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), *keys).limit(HOTTEST)
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_{k}") for k in keys], found.alias("_hot")))
    joined = rows.join(hot, [F.col(k) == F.col(f"_{k}") for k in keys], "left").drop(*[f"_{k}" for k in keys])
    # A hot row gives up its key: it is dealt by its place, and what it may meet is not used.
    dealt = {"bigint": F.xxhash64("row", "at"), "binary": F.xxhash64("row", "at").cast("string").cast("binary")}
    kinds = dict(names.dtypes)
    given = {f"_{k}": F.when(F.col("_hot").isNull(), F.col(k)).otherwise(dealt[kinds[k]]) for k in keys}
    side = names.select(*[F.col(k).alias(f"_{k}") for k in keys], found.alias("_found"))
    joined = joined.withColumns(given).join(side, list(given), "left").withColumn("_found", F.coalesce("_hot", "_found"))
    return joined.select(*rows.columns, "_found.*")


def _name_blocks(blocks: DataFrame, narrow: DataFrame) -> DataFrame:
    """``row``, ``at`` (place in the row), ``of`` (blocks of the row) and ``name`` of every block.

    ``narrow`` has the same rows as ``blocks``, without the blocks themselves.
    """
    names = named(blocks.groupBy("hash", "block").agg(F.count("*").alias("n")), ["hash", "block"], "block-names")
    shared = materialize(names.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared-hashes")
    if shared.isEmpty():
        return look_up(narrow, names.select("hash", "n", "name"), ["hash"]).drop("hash")
    alone = by_keys(names.select("hash", "n", "name"), F.col("hash"), shared, "left_anti")
    found = look_up(by_keys(narrow, F.col("hash"), shared, "left_anti"), alone, ["hash"])
    told = by_keys(names, F.col("hash"), shared, "left_semi").select("block", "n", "name")
    rest = look_up(by_keys(blocks, F.col("hash"), shared, "left_semi"), told, ["block"])
    return found.drop("hash").unionByName(rest.drop("hash", "block"))


def _name_pairs(level: DataFrame) -> DataFrame:
    """The next level: a row for each two adjacent names; a last one without partner is paired with 0."""
    side = [F.max(F.when(F.col("at").bitwiseAND(1) == s, F.col("name"))) for s in (0, 1)]
    pairs = level.groupBy("row", F.shiftright("at", 1).alias("at"), F.shiftright(F.col("of") + 1, 1).alias("of"))
    pairs = materialize(pairs.agg(side[0].alias("first"), F.coalesce(side[1], F.lit(0)).alias("second")), "pairs")
    names = named(pairs.groupBy("first", "second").agg(F.count("*").alias("n")), ["first", "second"], "pair-names")
    return look_up(pairs, names, ["first", "second"]).drop("first", "second")


def name_texts(blocks: DataFrame, narrow: DataFrame) -> DataFrame:
    """``row``, ``level`` and ``name`` of each row of blocks: the same for equal runs of blocks only."""
    level = materialize(_name_blocks(blocks, narrow), "named-blocks")
    longest = level.agg(F.max("of")).first()[0] or 0
    out, number = level.where("of = 1").select("row", F.lit(0).cast("long").alias("level"), "name"), 0
    while longest > 1:
        level = materialize(_name_pairs(level.where("of > 1")), "named-pairs")
        longest, number = (longest + 1) // 2, number + 1
        out = out.unionByName(level.where("of = 1").select("row", F.lit(number).cast("long").alias("level"), "name"))
    return out


def exact_groups(
    documents: DataFrame, key: str | Column = "doc_id", hashing: Callable[[Column], Column] = F.xxhash64, size: int = BLOCK
) -> DataFrame:
    """The group of equal texts of every row, dropped ones included.

    Returns ``doc_id`` (the values of ``key``), ``keep_id`` (that of the row that stays),
    ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text). Of equal texts
    the row with the most code points in the original text stays, then the one with the
    smallest key; a null key comes last, and of repeated rows one stays. Null texts count as
    empty; empty texts and those of white space are one group. An empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    value = documents[key] if isinstance(key, str) else key
    read = documents.select(scan_row().alias("row"), value.alias("doc_id"), whole_text().alias("text"))
    read = read.withColumn("data", normalised(F.col("text")).cast("binary"))
    cut = read.select("row", blocks_of(F.col("data"), size).alias("pieces"))
    blocks = cut.select("row", F.size("pieces").alias("of"), F.posexplode_outer("pieces").alias("at", "block"))
    blocks = blocks.withColumn("hash", hashing(F.col("block")))
    hashes = F.transform(blocks_of(F.col("data"), size), lambda block: hashing(block))
    facts = read.select("row", "doc_id", F.char_length("text").alias("chars"), F.sha2("data", 256).alias("text_sha256"), hashes.alias("hashes"))
    facts = materialize(facts, "texts")
    narrow = facts.select("row", F.size("hashes").alias("of"), F.posexplode("hashes").alias("at", "hash"))
    rows = facts.drop("hashes").join(name_texts(blocks, narrow), "row").withColumn("at", F.lit(0))
    rows = materialize(rows, "named-texts")
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("n"), best.alias("best"))
    groups = materialize(groups.select("level", "name", "n", "best.doc_id", "best.row"), "groups")
    groups = groups.withColumnsRenamed({"doc_id": "keep_id", "row": "keep_row"}).withColumn("group_size", F.col("n"))
    found = look_up(rows, groups, ["level", "name"], ("keep_id", "keep_row", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")

