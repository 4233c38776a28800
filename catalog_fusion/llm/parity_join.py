"""Exact Jaccard join of word shingles by parity sketches.

A set is XOR-hashed into a sketch: each shingle falls into one of ``m`` blocks and flips
bits there, kept as the XOR of the shingles' 64-bit hashes. A shingle that only one of
two sets has changes one block, so the number of blocks that differ, the sketches'
Hamming distance, never exceeds the symmetric difference. Sets with a Jaccard
similarity of 0.8 and sizes ``a <= b`` differ in at most ``(a + b) / 9`` shingles, at
most a quarter of either size: of all blocks, ordered in the same way for every set, the
first ``n // 4 + 1`` of two such sets must have one in common (pigeonhole). Sketches
are joined on these blocks within bands of sizes, and candidates are verified on the
sets themselves.

Sets that are equal form a class and take part once. Pairs of small buckets are counted:
as the blocks that both could share are known, too few in common rule a pair out. All
candidates then pass a second sketch, of one parity bit for each of some residues of the
hashes, whose Hamming distance has the same bound, before whole sets are fetched.

In each bucket the members are first compared with one of them, which settles families
of near copies. What is then still in different components is compared within the
bucket: the counted pairs of small ones, and in large ones, by blocks of bit sketches,
the nearest pairs of each two components, then the next, until none is left.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog_fusion.llm.tables import BROADCAST_KEYS, bound_batches, by_keys, content_key, result_schema, whole_text
from catalog_fusion.scratch import materialize

WORDS = 5
#: Similarity at least ``NUMERATOR / DENOMINATOR``. The bounds below hold for 0.8 only.
NUMERATOR, DENOMINATOR = 4, 5
#: Share of the texts that tells frequent blocks (which come last in the order), and blocks
#: that count as frequent, most frequent first. Either only changes the order.
SAMPLE, FREQUENT = 1 / 16, 200_000
#: Members of a bucket up to which pairs are counted, and of one block beyond.
SMALL, BLOCK = 32, 2048
#: Parts of a bucket that may be large.
PARTS = 64
#: Pairs of two components that a large bucket gives in each round, nearest first.
ROUNDS = (16, 1 << 62)
#: Pairs of a group that wait before the farther ones of each two components go.
_WAITING = 1 << 20
_BATCH_TEXT = 1 << 20

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash values of bytes (upper case as lower), and factors of places in a word and a shingle."""
    rng = np.random.default_rng(20261201)
    values = rng.integers(0, 1 << 64, 256, dtype=_U)
    values[65:91] = values[97:123]
    return values, rng.integers(0, 1 << 64, 64, dtype=_U) | _U(1), rng.integers(0, 1 << 64, WORDS, dtype=_U) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a text in bytes."""
    letter = ~_SPACES[data]
    edge = np.diff(letter.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, _U), starts
    values, powers, _ = _tables()
    lengths = ends - starts
    place = np.flatnonzero(letter)
    place_in_word = place - np.repeat(starts, lengths)
    # Beyond 64 bytes factors repeat, made odd multiples of the round they are in.
    factor = powers[place_in_word & 63] * (_U(2) * (place_in_word >> 6).astype(_U) + _U(1))
    terms = values[data[place]] * factor
    sums = np.add.reduceat(mix(terms), np.cumsum(lengths) - lengths)
    return mix(sums ^ lengths.astype(_U)), starts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    words, starts = word_hashes(data)
    stops = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, np.concatenate(([0], stops)))
    factors = _tables()[2]
    count = max(0, len(words) - WORDS + 1)
    rolled = np.zeros(count, _U)
    for j in range(WORDS):
        rolled += words[j : j + count] * factors[j]
    rolled = mix(rolled)
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if high - low >= WORDS:
            out.append(np.unique(rolled[low : high - WORDS + 1]))
        elif high > low:
            short = (words[low:high] * factors[: high - low]).sum(dtype=_U) + _U(high - low)
            out.append(mix(np.array([short], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def bands(size: int) -> list[int]:
    """Size bands of a set: its own and, if a partner a fifth smaller is below, that one."""
    own = 0
    while 8 ** (own + 1) <= size:
        own += 1
    return [own, own - 1] if own and DENOMINATOR * 8**own > NUMERATOR * size else [own]


def sketch(hashes: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the blocks that are not empty."""
    blocks = max(16, 4 * 8**band)
    block = (hashes >> _U(8)) % _U(blocks)
    order = np.argsort(block, kind="stable")
    block, hashes = block[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return block[first], np.bitwise_xor.reduceat(hashes, first)


def signatures(hashes: np.ndarray, frequent: np.ndarray, whole: bool = False) -> np.ndarray:
    """The first blocks of a set's sketches in the common order, hashed; ``whole``: all of them.

    Rare blocks come first by their hash, then frequent ones, then empty ones. The lowest
    bit says whether a block is one of the latter two, of which many sets may have the same.
    """
    if not len(hashes):
        return np.zeros(0, _U)
    wanted, out = len(hashes) // 4 + 1, []
    for band in bands(len(hashes)):
        block, value = sketch(hashes, band)
        salt = _U((band + 1) << 56)
        names = mix(mix(block + salt) ^ value)
        late = np.zeros(len(names), bool)
        if len(frequent):
            late = frequent[np.minimum(np.searchsorted(frequent, names), len(frequent) - 1)] == names
        if whole:
            out.append(names)
            continue
        order = np.lexsort((names, late))
        names = (names & ~_U(1) | late.astype(_U))[order]
        if len(names) < wanted:
            empty = np.setdiff1d(np.arange(max(16, 4 * 8**band), dtype=_U), block)
            names = np.concatenate((names, np.sort(mix(mix(empty + salt))) | _U(1)))
        out.append(names[:wanted])
    return np.concatenate(out)


def _grouped(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows with a few MB of text."""
    low, size, texts = 0, 0, []
    for i, value in enumerate(column):
        texts.append(value.as_buffer().to_pybytes())
        size += len(texts[-1])
        if size >= _BATCH_TEXT or i + 1 == len(column):
            yield low, i + 1, texts
            low, size, texts = i + 1, 0, []


def _frequent(source: DataFrame) -> np.ndarray:
    """Blocks that three or more of a sample of different texts share."""
    drawn = source.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(SAMPLE * (1 << 30))).select("text").distinct()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, _U)
        for batch in batches:
            for _, _, texts in _grouped(batch.column(0)):
                names = [np.unique(signatures(s, none, whole=True)) for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64))], names=["name"])

    counted = drawn.mapInArrow(blocks, "name long").groupBy("name").agg(F.count("*").alias("n")).where("n >= 3")
    rows = counted.orderBy(F.desc("n"), "name").limit(FREQUENT).select("name").collect()
    return np.sort(np.array([r["name"] for r in rows], np.int64).view(_U))


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each set; of the empty set 0."""
    halves = [[int(mix(s ^ _U(salt)).sum(dtype=_U)) for s in sets] for salt in (1, 2)]
    named = mix(np.array(halves[0], _U)) ^ np.array(halves[1], _U)
    return np.where([len(s) > 0 for s in sets], mix(named), _U(0)).view(np.int64)


def _named(source: DataFrame) -> DataFrame:
    """``key``, ``content``, the size of the set and its name, ``node``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in _grouped(batch.column(2)):
                sets = shingle_sets(texts)
                front = [batch.column(i).slice(low, high - low) for i in (0, 1)]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*front, sizes, pa.array(_names(sets))], names=["key", "content", "n", "node"])

    return source.mapInArrow(work, result_schema(source, "content long, n long, node long"))


def _sketched(source: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``name`` and ``node`` of the first blocks of every set. A task gives a set once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, texts in _grouped(batch.column(0)):
                sets = shingle_sets(texts)
                nodes = _names(sets)
                new = [i for i, node in enumerate(nodes.tolist()) if len(sets[i]) and not (node in seen or seen.add(node))]
                if new:
                    names = [signatures(sets[i], frequent) for i in new]
                    nodes = np.repeat(nodes[new], [len(x) for x in names])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(nodes)], names=["name", "node"])

    return source.select("text").mapInArrow(work, "name long, node long")


def _of_nodes(source: DataFrame, classes: DataFrame, nodes: DataFrame, work, columns: str) -> DataFrame:
    """What ``work`` makes of the sets with these numbers, one row for each."""
    wanted = materialize(classes.join(nodes.distinct(), "node").select("content", "node"), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in _grouped(batch.column(1)):
                packed = pa.array([work(s).tobytes() for s in shingle_sets(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), packed], names=["node", columns])

    rows = source.select("content", "text").join(side, "content").select("node", "text")
    return rows.mapInArrow(each, f"node long, {columns} binary").dropDuplicates(["node"])


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """One parity bit for each residue of the hashes: four bits to a shingle or more, packed."""
    bits = 1 << max(10, int(4 * len(hashes) - 1).bit_length())
    flips = np.bincount((hashes % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(_U)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits, as if made with them."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def _paired(pairs: DataFrame, values: DataFrame, value: str, judge, keep: list[str]) -> DataFrame:
    """The pairs ``x, y`` for which ``judge`` holds for their two packed values."""
    left = values.select(F.col("node").alias("x"), F.col(value).alias("value_x"))
    right = values.select(F.col("node").alias("y"), F.col(value).alias("value_y"))
    joined = pairs.join(left, "x").join(right, "y").select(*keep, "value_x", "value_y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pydict()
            values = zip(table["value_x"], table["value_y"], strict=True)
            sizes = zip(table["n_x"], table["n_y"], strict=True) if "n_x" in table else [None] * len(batch)
            kept = [judge(np.frombuffer(a, _U), np.frombuffer(b, _U), n) for (a, b), n in zip(values, sizes, strict=False)]
            yield batch.select(keep).filter(pa.array(kept, pa.bool_()))

    return joined.mapInArrow(work, pairs.select(*keep).schema)


def _near(pairs: DataFrame, sketches: DataFrame, keep: list[str]) -> DataFrame:
    """Those of the pairs, with sizes, that bit sketches do not rule out."""
    return _paired(pairs, sketches, "bits", lambda a, b, n: 9 * sketch_distance(a, b) <= sum(n), [*keep, "n_x", "n_y"]).select(*keep)


def _similar(a: np.ndarray, b: np.ndarray, _) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _similar_sizes(a: Column, b: Column) -> Column:
    return (DENOMINATOR * a >= NUMERATOR * b) & (DENOMINATOR * b >= NUMERATOR * a)


def _linked(source: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs ``x, y`` that are similar enough."""
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node"))
    sets = _of_nodes(source, classes, nodes, lambda s: s, "hashes")
    return materialize(_paired(pairs, sets, "hashes", _similar, ["x", "y"]), "links")


def _ranked(pairs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``distance, i, j`` by distance, then places, and each one's rank among those of its two labels."""
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    ends = np.sort(labels[pairs[:, 1:]], 1)
    together = np.lexsort((ends[:, 1], ends[:, 0]))  # stable: by distance within two labels
    new = np.flatnonzero(np.any(np.diff(ends[together], axis=0, prepend=-1), 1)) if len(ends) else np.zeros(0, np.int64)
    rank = np.empty(len(pairs), np.int64)
    rank[together] = np.arange(len(pairs)) - np.repeat(new, np.diff(new, append=len(pairs)))
    return pairs, rank


def _nearest(sketches: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, blocks: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``distance, i, j`` of pairs with different labels, and blocks if given, that may be linked, and their ranks.

    Of each two labels only the ``most`` nearest are held.
    """
    widths = np.array([len(s) for s in sketches])
    held, waiting = [np.zeros((0, 3), np.int64)], 0

    def pruned() -> np.ndarray:
        pairs, rank = _ranked(np.concatenate(held), labels)
        return pairs[rank < most]

    for width in sorted(set(widths.tolist())):
        own, above = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        place = np.concatenate((own, above))
        bits = np.stack([folded(sketches[p], width) for p in place])
        for k in range(len(own)):
            i, rest = own[k], place[k + 1 :]
            low, high = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
            fits = (labels[i] != labels[rest]) & (DENOMINATOR * low >= NUMERATOR * high)
            if blocks is not None:
                fits &= blocks[i] != blocks[rest]
            at = np.flatnonzero(fits)
            if len(at):
                far = np.bitwise_count(bits[k] ^ bits[k + 1 :][at]).sum(1, dtype=np.int64)
                near = np.flatnonzero(9 * far <= (low + high)[at])
                j = rest[at][near]
                held.append(np.stack((far[near], np.minimum(i, j), np.maximum(i, j)), 1))
                waiting += len(j)
                if waiting > _WAITING:
                    held, waiting = [pruned()], 0
    return _ranked(pruned(), labels)


def _next_pairs(members: DataFrame, sketches: DataFrame, low: int, high: int) -> DataFrame:
    """Of each two components in a large bucket, the pairs that come ``low`` to ``high`` by distance.

    A bucket is dealt into blocks of members, and two blocks meet in one group.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = dealt.withColumn("other", other).select(
        "name", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "label"
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        apart = frame["low"].iat[0] != frame["high"].iat[0]
        # Places in the frame depend on the order of fetches. Ordered by nodes, ranks are the
        # same in every round, so that a round skips what earlier ones gave and nothing else.
        frame = frame.sort_values("node")
        nodes, labels, blocks, sizes = (frame[c].to_numpy() for c in ("node", "label", "block", "n"))
        near, rank = _nearest([np.frombuffer(b, _U) for b in frame["bits"]], sizes, labels, blocks if apart else None, high)
        near = nodes[near[rank >= low, 1:]]
        return pd.DataFrame({"x": near[:, 0], "y": near[:, 1]}, dtype="int64")

    return met.join(sketches, "node").groupBy("name", "low", "high").applyInPandas(compare, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for every node with an edge.

    Alternating stars: each node hooks its larger neighbours, then its smaller ones, to
    the smallest node it knows, until nothing changes. Sums and joins only.
    """

    def hooked(pairs: DataFrame, larger: bool) -> DataFrame:
        known = pairs.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        joined = pairs.join(known, "u")
        if larger:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        tops = known.select("u", F.col("least").alias("v"))
        return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(tops).where("u != v")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = materialize(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = state(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hooked(both, larger=True).distinct()
        pairs = materialize(hooked(large, larger=False).distinct(), "edges")
        after = state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.withColumn("label", F.col("node")))


def jaccard_components(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every row's set and component.

    Returns ``key``, ``content`` (see ``content_key``), ``n_shingles``, ``component`` (null
    if nothing else is linked) and ``component_id``, the smallest ``key`` reachable by
    links, the row's own included. Two rows are linked if the Jaccard similarity of their
    sets of five-word shingles is 0.8 or more; texts of fewer words have the whole
    sequence as their one shingle, and without words no set and no link. Null keys are
    passed over for the smallest key. Repeated rows are linked copies, an empty table gives
    no rows, and other columns are not read.
    """
    bound_batches(documents.sparkSession)
    source = documents.select(F.col(key).alias("key"), content_key().alias("content"), whole_text().alias("text"))
    rows = materialize(_named(source), "named")
    classes = rows.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("key").alias("least"), F.min("content").alias("content"))
    classes = materialize(classes, "classes")
    # Buckets that may be large are dealt into parts, each with a first member of its own.
    frequent = F.col("name").bitwiseAND(1) == 1
    part = Window.partitionBy("name", "part")
    buckets = (
        _sketched(source, _frequent(source))
        .withColumn("part", F.when(frequent, F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(F.lit(0)))
        .withColumns({"part_first": F.min("node").over(part), "part_last": F.max("node").over(part)})
        .where((F.col("part_first") != F.col("part_last")) | frequent)
        .select("name", "node", "part_first")
        .distinct()
    )
    buckets = materialize(buckets, "buckets")
    bucket = buckets.groupBy("name").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
    members = buckets.join(bucket, "name").join(classes.select("node", "n"), "node")
    members = materialize(members.select("name", "node", "n", "size", "first", "part_first"), "members")
    small, large = members.where(F.col("size") <= SMALL), members.where(F.col("size") > SMALL)

    # Of the first blocks of two linked sets, at most a ninth of both sizes differ.
    often = large.groupBy("node").agg(F.count("*").alias("often"))
    x = small.select("name", F.col("node").alias("x"), F.col("n").alias("n_x"), "first")
    y = small.select("name", F.col("node").alias("y"), F.col("n").alias("n_y"))
    met = x.join(y, "name").where((F.col("x") < F.col("y")) & _similar_sizes(F.col("n_x"), F.col("n_y")))
    met = met.groupBy("x", "y", "n_x", "n_y").agg(F.count("*").alias("shared"), F.max(F.col("x") == F.col("first")).alias("star"))
    often_x, often_y = (often.select(F.col("node").alias(c), F.col("often").alias(f"often_{c}")) for c in "xy")
    met = met.join(often_x, "x", "left").join(often_y, "y", "left")
    most = F.col("shared") + F.least(F.coalesce("often_x", F.lit(0)), F.coalesce("often_y", F.lit(0)))
    read = F.floor(F.least("n_x", "n_y") / 4) + 1
    pairs = met.where(read - most <= F.floor((F.col("n_x") + F.col("n_y")) / 9)).select("x", "y", "n_x", "n_y", "star")
    stars = large.select(F.col("part_first").alias("x"), F.col("node").alias("y"))
    stars = stars.unionByName(large.select(F.col("first").alias("x"), F.col("part_first").alias("y"))).where("x != y").distinct()
    of_x, of_y = (classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "xy")
    stars = stars.join(of_x, "x").join(of_y, "y").where(_similar_sizes(F.col("n_x"), F.col("n_y")))
    pairs = pairs.unionByName(stars.select("x", "y", "n_x", "n_y", F.lit(True).alias("star")))
    pairs = materialize(pairs, "pairs")

    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).unionByName(large.select("node"))
    sketches = materialize(_of_nodes(source, classes, nodes, bit_sketch, "bits"), "bits")
    pairs = materialize(_near(pairs, sketches, ["x", "y", "star"]), "near")
    links = _linked(source, classes, pairs.where("star").select("x", "y").distinct())
    known = materialize(components(links), "components")

    # What still is in different components.
    rest = pairs.where("not star").select("x", "y")
    done = 0
    for upto in ROUNDS:
        labelled = large.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = labelled.groupBy("name").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        labelled = labelled.join(mixed.select("name"), "name").select("name", "size", "node", "n", "label")
        more = materialize(_next_pairs(labelled, sketches, done, upto).distinct(), "next")
        label_x, label_y = (known.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in "xy")
        rest = rest.join(label_x, "x", "left").join(label_y, "y", "left")
        rest = rest.where(F.coalesce("label_x", "x") != F.coalesce("label_y", "y")).select("x", "y")
        todo = materialize(rest.unionByName(more).distinct(), "rest")
        if not todo.isEmpty():
            links = links.unionByName(_linked(source, classes, todo))
            known = materialize(components(links), "components")
        if more.isEmpty():
            break
        rest, done = todo.limit(0), upto
    named = classes.select("node", "least").join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "label").select("node", F.col("label").alias("component"), "component_id")
    out = rows.join(by_set, "node", "left")
    return out.select(
        F.col("key").alias(key), "content", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "key").alias("component_id")
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: the smallest id, then the smallest content.

    Texts without words all stay. Which rows go is decided on narrow tables; of copies
    that share id and text any one is as good.
    """
    found = materialize(jaccard_components(documents), "found").where("component is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "content")
    chosen = found.groupBy("component").agg(F.min_by("content", order).alias("chosen"), F.count("*").alias("copies"))
    several = chosen.where("copies > 1")
    judged = found.join(several.select("component", "chosen"), "component")
    kept = by_keys(documents, content_key(), judged.where("content != chosen").select("content"), "left_anti")
    same = judged.where("content = chosen").groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    same = materialize(same, "copies")
    again = by_keys(kept, content_key(), same, "left_semi")
    one = again.withColumn("__content", content_key()).dropDuplicates(["__content"]).drop("__content")
    return by_keys(kept, content_key(), same, "left_anti").unionByName(one)
