"""Benchmark decontamination by templates.

Numbers, the units behind them, and names are replaced with typed placeholders, and the
windows of the templates that documents and benchmark items share are found by a hash
join. Each shared window carries what its placeholders stood for on both sides. Along an
alignment of a document with an item these slots must be consistent: equal values of
the item stand for equal values of the document. So a question that was only given new
numbers and names is caught, and text that merely has the same shape is not. A clash
takes the windows that hold it, not the whole alignment.

A capitalised word that opens a sentence may be a name or not. Windows that hold one are
made in both forms, and count as found if either form joins.

A template of mostly placeholders says too little: windows with few literal words, such as
sums and lists of names, are joined by their own words instead, so that copies of them are
found. Windows that many items share do not multiply: they count for the pairs that other
windows found, and open pairs only for items that are mostly made of them.

Before the join, windows of documents pass a bit map of the benchmark's windows, whose
size is fixed; it drops most of them and never one that has a partner.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_fusion.llm.tables import bound_batches, by_keys, content_key, result_schema, scan_row, whole_text
from catalog_fusion.scratch import materialize

#: Template words of a window, and literal ones among them at least (of shorter items: half).
WINDOW, LITERALS = 8, 4
#: Share of an item's distinct windows that a document must hold.
SHARE = 0.25
#: Items that share a window which opens no pairs, at least.
COMMON = 64
#: Bits of the map of benchmark windows.
MAP_BITS = 1 << 22
_REMEMBERED = 300_000
_BATCH_TEXT = 1 << 20
#: Windows whose forms are made at once.
_FORMED = 1 << 15

#: Units of measure, after a number only.
UNITS = frozenset(
    """
    mm cm m km in inch inches ft foot feet yd yard yards mile miles
    mg g kg t gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds
    ml cl l litre litres liter liters gallon gallons
    s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
    dollar dollars euro euros cent cents usd eur gbp percent degrees mph kmh w kw kwh v a hz gb mb kb
    """.split()
)

_TOKEN = re.compile(r"\d(?:[\d.,]*\d)?|[^\W\d_]+|[.!?]")
_LITERAL, _NUMBER, _UNIT, _NAME, _STOP = range(5)
_U = np.uint64
_BARE = 1 << WINDOW  # in place of names: the window's own words


class _Tokens(dict):
    """Number of each distinct token, and columns of what is known of them."""

    def __init__(self):
        super().__init__()
        self.kinds: list[int] = []
        self.values: list[int] = []

    def __missing__(self, token: str) -> int:
        if token in ".!?":
            kind = _STOP
        elif token[0].isdigit():
            kind = _NUMBER
        elif token.lower() in UNITS:
            kind = _UNIT
        else:
            kind = _NAME if token[0].isupper() and token[1:].islower() else _LITERAL
        self.kinds.append(kind)
        self.values.append(xxhash.xxh3_64_intdigest(token.lower()))
        self[token] = number = len(self)
        return number


def canonical(texts: list[str], tokens: _Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, template value, own value and placeholder flag of every word, in order."""
    return _words(texts, tokens)[:4]


def _words(texts: list[str], tokens: _Tokens) -> tuple[np.ndarray, ...]:
    """What ``canonical`` gives, and whether a word opens a sentence and may be a name as well."""
    found = [_TOKEN.findall(t) for t in texts]
    numbers = np.fromiter(map(tokens.__getitem__, chain.from_iterable(found)), np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    kinds, values = np.array(tokens.kinds, np.int8)[numbers] if len(numbers) else np.zeros(0, np.int8), np.array(tokens.values, _U)
    values = values[numbers] if len(numbers) else np.zeros(0, _U)
    # A capital is a name inside a sentence, and a unit's word one behind a number.
    before = np.concatenate(([_STOP], kinds[:-1])) if len(kinds) else kinds
    if len(owner):
        before[np.flatnonzero(np.diff(owner, prepend=-1))] = _STOP
    either = (kinds == _NAME) & (before == _STOP)
    kinds = np.where(either, _LITERAL, kinds)
    kinds = np.where((kinds == _UNIT) & (before != _NUMBER), _LITERAL, kinds)
    kept = kinds != _STOP
    owner, kinds, values, either = owner[kept], kinds[kept], values[kept], either[kept]
    return owner, np.where(kinds == _LITERAL, values, kinds.astype(_U)), values, kinds != _LITERAL, either


def _mixed(rolled: np.ndarray) -> np.ndarray:
    rolled = (rolled ^ (rolled >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return rolled ^ (rolled >> _U(33))


def _windows(
    owner: np.ndarray, template: np.ndarray, values: np.ndarray, slots: np.ndarray, either: np.ndarray, size: int, bits: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash, identity, and places of names of each window in each of its forms.

    A window with literals enough has a form for each choice of the words that may be names.
    One that has too few, or might where other words stand before it, has its own words as a
    form, with no placeholder. Forms not in ``bits`` go.
    """
    count = max(0, len(owner) - size + 1)
    rng = np.random.default_rng(20261201 + size)
    factors = rng.integers(0, 1 << 63, size, dtype=_U) | _U(1)
    terms = template ^ (template >> _U(31))

    def rolled_over(terms: np.ndarray, start: int) -> np.ndarray:
        rolled = np.full(count, start, _U)
        for j in range(size):
            rolled += terms[j : j + count] * factors[j]
        return rolled

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[size : size + count] - sums[:count]

    def kept(names: np.ndarray) -> np.ndarray:
        if bits is None:
            return np.ones(len(names), bool)
        place = (names % _U(MAP_BITS)).astype(np.int64)
        return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

    rolled, same = rolled_over(terms, size), owner[:count] == owner[size - 1 : size - 1 + count]
    spare = size - within(slots) - min(LITERALS, (size + 1) // 2)
    good = np.flatnonzero(same & (spare >= 0))
    bare = np.flatnonzero(same & (spare < within(either)))
    own = _mixed(rolled_over(values ^ (values >> _U(31)), size + WINDOW + 1)[bare])
    hit = kept(own)
    bare, own = bare[hit], own[hit]
    out = [(bare, own, np.where(spare[bare] >= 0, _mixed(rolled[bare]), own), np.full(len(bare), _BARE, np.uint16))]
    for low in range(0, len(good), _FORMED):
        at = good[low : low + _FORMED]
        form, named = rolled[at], np.zeros(len(at), np.uint16)
        for j in range(size):
            more = np.flatnonzero(either[at + j] & (np.bitwise_count(named) < spare[at]))
            if len(more):
                other = form[more] + (_U(_NAME) - terms[at[more] + j]) * factors[j]
                form, named = np.concatenate((form, other)), np.concatenate((named, named[more] | np.uint16(1 << j)))
                at = np.concatenate((at, at[more]))
        names = _mixed(form)
        hit = kept(names)
        at, names, named = at[hit], names[hit], named[hit]
        out.append((at, names, _mixed(rolled[at]), named))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FIELDS = "at long, size int, name long, window long, slots array<long>"


def _window_rows(keys: pa.Array, texts: list[str], tokens: _Tokens, sizes: list[int] | None, bits: np.ndarray | None) -> pa.RecordBatch:
    """``key``, place, hash and slot values of windows; ``sizes`` None: whole items, one size each."""
    if len(tokens) > _REMEMBERED:
        tokens.clear()
        tokens.kinds.clear()
        tokens.values.clear()
    owner, template, values, slots, either = _words(texts, tokens)
    first = np.searchsorted(owner, np.arange(len(texts)))
    rows = []
    if sizes is None:
        lengths = np.minimum(np.bincount(owner, minlength=len(texts)), WINDOW)
        for size in sorted(set(lengths.tolist()) - {0}):
            found = _windows(owner, template, values, slots, either, size)
            own = lengths[owner[found[0]]] == size
            rows.append((*(x[own] for x in found), np.full(own.sum(), size)))
    else:
        for size in sizes:
            found = _windows(owner, template, values, slots, either, size, bits)
            rows.append((*found, np.full(len(found[0]), size)))
    none = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.uint16), np.zeros(0, np.int64))
    at, names, plain, named, spans = (np.concatenate(x) for x in zip(none, *rows, strict=True))
    chosen = (named[:, None] >> np.arange(WINDOW, dtype=np.uint16) & 1).astype(bool)
    empty = values[:0]
    lists = [
        empty if bare else values[a : a + n][slots[a : a + n] | c[:n]]
        for a, n, c, bare in zip(at.tolist(), spans.tolist(), chosen, (named == _BARE).tolist(), strict=True)
    ]
    offsets = pa.array(np.cumsum([0] + [len(x) for x in lists]), pa.int32())
    flat = np.concatenate(lists) if lists else np.zeros(0, _U)
    return pa.RecordBatch.from_arrays(
        [
            keys.take(pa.array(owner[at], pa.int64())),
            pa.array(at - first[owner[at]], pa.int64()),
            pa.array(spans, pa.int32()),
            pa.array(names.view(np.int64)),
            pa.array(plain.view(np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))),
        ],
        names=["key", "at", "size", "name", "window", "slots"],
    )


def _rows(source: DataFrame, sizes: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            low, held, texts = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                texts.append(value.as_py())
                held += len(texts[-1])
                if held >= _BATCH_TEXT or i + 1 == len(batch):
                    yield _window_rows(batch.column(0).slice(low, i + 1 - low), texts, tokens, sizes, bits)
                    low, held, texts = i + 1, 0, []

    return source.mapInArrow(work, result_schema(source, _FIELDS))


def _same(pairs: Column) -> Column:
    return F.forall(pairs, lambda p: p["slots"] == p["item_slots"])


def _consistent(aligned: DataFrame) -> DataFrame:
    """Alignments with those of their windows ``found`` whose slot ``pairs`` can stand together.

    All of them, if each item value stands for one document value; two may become the same
    one. Where values clash, readings that are one-to-one are settled, the item's own values
    first, then the commonest, and windows that hold another drop out, as if a literal had
    changed. Windows with the item's own values always stay.
    """

    def rank(p: Column) -> Column:
        times = F.size(F.filter("held", lambda q: q == p))
        return F.struct((p["slots"] != p["item_slots"]).alias("other"), (-times).alias("times"), p.alias("pair"))

    def settle(kept: Column, p: Column) -> Column:
        taken = F.exists(kept, lambda k: (k["slots"] == p["slots"]) | (k["item_slots"] == p["item_slots"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(p)))

    def stays(window: Column) -> Column:
        return _same(window["pairs"]) | F.forall(window["pairs"], lambda p: F.array_contains("reading", p))

    clash = F.size("pairs") > F.size(F.array_distinct("pairs.item_slots"))
    ranked = F.transform(F.array_sort(F.transform("pairs", rank)), lambda r: r["pair"])
    aligned = aligned.withColumn("held", F.flatten("found.pairs")).withColumn("pairs", F.array_distinct("held")).withColumn("clash", clash)
    aligned = aligned.withColumn("ranked", F.when(F.col("clash"), ranked))
    aligned = aligned.withColumn("reading", F.aggregate("ranked", F.slice("ranked", 1, 0), settle))
    return aligned.withColumn("found", F.when(F.col("clash"), F.filter("found", stays)).otherwise(F.col("found")))


def _item_windows(benchmark: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Windows of every item, and the items: an item is a distinct ``item_id`` and text.

    Windows say whether they are ``common``, which those of an item that has ``share`` in
    common windows alone never are.
    """
    items = benchmark.select("item_id", whole_text().alias("text")).distinct()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    rows = _rows(items.select(F.col("item").alias("key"), "text"), None, None)
    # Of equal windows of an item one is enough: they are counted once.
    rows = rows.groupBy(F.col("key").alias("item"), "size", "name", "window", F.col("slots").alias("item_slots")).agg(F.min("at").alias("item_at"))
    rows = materialize(rows, "item-windows")
    spread = rows.groupBy("name").agg(F.countDistinct("item").alias("items")).where(F.col("items") > COMMON).select("name", F.lit(True).alias("shared"))
    rows = rows.join(spread, "name", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    totals = rows.groupBy("item").agg(F.countDistinct("window").alias("total"), F.countDistinct(F.when(F.col("shared"), F.col("window"))).alias("alike"))
    totals = totals.withColumn("made_of", (F.col("alike") > 0) & (F.col("alike") >= F.lit(share) * F.col("total")))
    rows = rows.join(totals, "item").withColumn("common", F.col("shared") & ~F.col("made_of"))
    rows = materialize(rows.drop("shared", "alike", "made_of", "total"), "item-forms")
    return rows, materialize(items.drop("text").join(totals.select("item", "total"), "item"), "item-totals")


def find_leaks(documents: DataFrame, benchmark: DataFrame, key: str | Column = "doc_id", share: float = SHARE) -> DataFrame:
    """Documents that hold benchmark items: a row for each pair.

    Returns ``doc_id`` (the values of ``key``), ``item_id``, ``windows`` (distinct windows of
    the item found at consistent slots), ``share`` (of the item's) and ``verbatim`` (whether
    all slots found have the item's own values). A row of ``documents`` gives a pair if
    ``share`` of the item's windows are found. Rows that are clean, null or empty give
    none; repeated rows give theirs each. An item is a text with its id, which may be null;
    repeated items count as one, and of several texts with one id the pair has the one of
    which most is found. Items without words match nothing, and items shorter than a
    window are found whole. Empty tables give no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    items, totals = _item_windows(benchmark, share)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # up to WINDOW
    # At most MAP_BITS numbers, however many windows there are.
    places = items.select(F.col("name").bitwiseAND(MAP_BITS - 1).cast("int").alias("place")).distinct()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    place = places.toArrow().column("place").to_numpy()
    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    value = documents[key] if isinstance(key, str) else key
    source = documents.select(F.struct(scan_row().alias("row"), value.alias("id")).alias("key"), whole_text().alias("text"))
    found = materialize(_rows(source, sizes, bits).select("key.row", "key.id", "at", "name", "slots"), "document-windows")
    line = ["row", "id", "item", "shift"]
    opening, common = items.where("not common").drop("common"), items.where("common").drop("common")
    matched = found.join(opening, "name")
    if not common.isEmpty():
        opened = matched.select("row", "item").distinct()
        more = found.join(common.select("name").distinct(), "name", "left_semi")
        matched = matched.unionByName(more.join(opened, "row").join(common, ["item", "name"]).select(matched.columns))
    matched = matched.withColumn("shift", F.col("at") - F.col("item_at"))
    pairs = F.arrays_zip("slots", "item_slots").alias("pairs")
    # Of the forms of a window that join, the one with the fewest names.
    formed = matched.groupBy(*line, "at").agg(F.min_by(F.struct("window", pairs), F.size("slots")).alias("form"))
    aligned = formed.groupBy(*line).agg(F.collect_list("form").alias("found"))
    held = (
        _consistent(aligned).select("row", "id", "item", F.explode("found").alias("found"))
        .select("row", "id", "item", "found.window", _same(F.col("found.pairs")).alias("same"))
        .groupBy("row", "id", "item")
        .agg(F.countDistinct("window").alias("windows"), F.min("same").alias("verbatim"))
    )
    part = (F.col("windows") / F.col("total")).alias("share")
    best = held.join(totals, "item").where(part >= share).groupBy("row", "id", "item_id").agg(F.max(F.struct(part, "windows", "verbatim")).alias("best"))
    return best.select(F.col("id").alias("doc_id"), "item_id", "best.windows", "best.share", "best.verbatim")


def without_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``documents`` in which no item is found."""
    leaks = materialize(find_leaks(documents, benchmark, content_key(), share).select("doc_id").distinct(), "leaks")
    return by_keys(documents, content_key(), leaks, "left_anti")
