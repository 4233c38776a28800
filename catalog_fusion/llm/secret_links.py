"""Secret scans that link the parts of multipart credentials.

Three kinds of span are reported wherever they occur: ``assign``, ``access`` and
``hex``. Three weak kinds, ``ident`` (account or client names), ``part`` (short names
for keys and passwords) and ``endpoint`` (service addresses), are common in harmless
text. They are reported only if complementary parts lie in their scope: an identifier
beside a secret, a secret beside an identifier or endpoint, an endpoint beside both.
The scope reaches ``scope`` code points from the start of one span to that of another.

The interval join of parts is a sorted sweep: the parts of a text are ordered by their
start, and a range frame says which roles occur around each. No pair is formed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog_fusion.llm.tables import scan_row, whole_text
from catalog_fusion.scratch import materialize

_SET = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A pattern; a hit counts if ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int
    least: int
    role: str
    weak: bool


#: In the order in which spans of the same start are listed.
KINDS = (
    Kind("assign", rf"(?i:(password|passwd|secret|token|api_?key)){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6, "secret", False),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "ident", False),
    # Runs are taken whole, so the least length can stand in the pattern itself.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, "secret", False),
    Kind("ident", rf"(?i:\b(?:client_id|account(?:_id)?|user(?:_?name)?|login|key_id)){_SET}([A-Za-z0-9@._-]+)", 1, 3, "ident", True),
    Kind("part", rf"(?i:\b(?:pwd|pass|auth|credential|private_key)){_SET}([A-Za-z0-9+/_.=-]+)", 1, 6, "secret", True),
    Kind("endpoint", r"""\b(?:https?|s3|postgres|mysql|redis|mongodb|amqp)://[^\s"'<>]+""", 0, 10, "endpoint", True),
)


def _hits(text: Column, order: int, kind: Kind) -> Column:
    """Matches of one kind, leftmost first, with the text between them.

    ``split`` and ``regexp_extract_all`` see the same matches, so the lengths of gaps
    and matches add up to positions.
    """
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")),
    )
    wanted = lambda hit: hit if kind.group == 0 else F.regexp_extract(hit, kind.pattern, kind.group)
    return F.transform(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        lambda p, i: F.struct(
            F.lit(order).alias("kind"),
            i.alias("at"),
            p["gap"].alias("gap"),
            F.char_length(p["hit"]).alias("chars"),
            (F.char_length(wanted(p["hit"])) >= kind.least).alias("kept"),
        ),
    )


def _one_of(kinds: list[int]) -> Column:
    return F.max(F.col("kind").isin(kinds))


def linked_spans(
    documents: DataFrame, scope: int = 200, key: str = "doc_id", row: Column | None = None
) -> DataFrame:
    """Spans of every row: ``row``, ``key`` and ``spans`` of ``(start, kind, end, past)``.

    ``row`` is a unique number for each row, by default the one of ``scan_row``. Positions are code points, ends
    exclusive, ``kind`` the place in ``KINDS``, ``past`` the greatest end of the spans
    before; spans come sorted. Null and empty texts
    have none, repeated rows are scanned each, an empty table gives no rows. What is
    gathered for a row is bounded by its own text.
    """
    rows = documents.select((scan_row() if row is None else row).alias("row"), F.col(key).alias("key"), whole_text().alias("body"))
    # A hit of no kind stands for the row itself, so that none goes with its hits.
    stub = F.array(F.lit(None).cast("struct<kind:int,at:int,gap:int,chars:int,kept:boolean>"))
    parts = F.concat(*[_hits(F.col("body"), i, k) for i, k in enumerate(KINDS)], stub)
    hits = rows.select("row", "key", F.explode(parts).alias("hit")).select("row", "key", "hit.*")
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("chars")).over(before).cast("int")
    placed = (
        hits.repartition("row")
        .select("row", "key", "kind", "chars", "kept", end.alias("end"))
        .withColumn("start", F.col("end") - F.col("chars"))
        .where("kept or kind is null")
    )
    around = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    roles = {r: [i for i, k in enumerate(KINDS) if k.role == r] for r in ("ident", "secret", "endpoint")}
    near = {r: F.coalesce(_one_of(kinds).over(around), F.lit(False)) for r, kinds in roles.items()}
    seen = placed.select("row", "key", "kind", "start", "end", *[c.alias(f"near_{r}") for r, c in near.items()])
    joined = {
        "ident": F.col("near_secret"),
        "secret": F.col("near_ident") | F.col("near_endpoint"),
        "endpoint": F.col("near_secret") & F.col("near_ident"),
    }
    reported = F.lit(False)
    for i, k in enumerate(KINDS):
        reported = reported | ((F.col("kind") == i) & (joined[k.role] if k.weak else F.lit(True)))
    earlier = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.max(F.when(F.col("reported"), F.col("end"))).over(earlier), F.lit(0))
    marked = seen.withColumn("reported", reported).withColumn("past", past)
    span = F.struct("start", "kind", "end", "past")
    return (
        marked.groupBy("row")
        .agg(F.max("key").alias("key"), F.sort_array(F.collect_list(F.when(F.col("reported"), span))).alias("spans"))
        .select("row", F.col("key").alias(key), "spans")
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def may_hold_secrets(text: Column) -> Column:
    """Whether any pattern occurs at all."""
    found = F.lit(False)
    for kind in KINDS:
        found = found | text.rlike(kind.pattern)
    return found


def redact(documents: DataFrame, scope: int = 200, mask: str = "[secret]") -> DataFrame:
    """``documents`` with every reported span replaced by ``mask``.

    Overlapping spans are replaced as one. Columns and their order stay; nulls, empty
    texts and empty tables pass. Only texts in which some pattern occurs are staged and
    shuffled, so that their rows keep one identity; the others pass in place.
    """
    row, spans = "__secret_row", "__secret_spans"
    suspect = F.coalesce(may_hold_secrets(F.col("text")), F.lit(False))
    clean = documents.where(~suspect)
    held = materialize(documents.where(suspect).withColumn(row, scan_row()), "suspects")
    marks = linked_spans(held, scope, documents.columns[0], F.col(row)).where(F.size("spans") > 0)
    marks = marks.select(F.col("row").alias(row), F.col("spans").alias(spans))
    tail = F.array_max(F.transform(spans, lambda s: s["end"]))
    # An overlapping span adds nothing before it, and the text goes on past both.
    parts = F.transform(
        spans,
        lambda s: F.when(
            s["start"] >= s["past"],
            F.concat(F.substring(F.col("text"), s["past"] + 1, s["start"] - s["past"]), F.lit(mask)),
        ).otherwise(""),
    )
    text = F.concat(F.array_join(parts, ""), F.substr(F.col("text"), tail + 1))
    masked = held.join(marks, row, "left").withColumn("text", F.when(F.col(spans).isNotNull(), text).otherwise(F.col("text")))
    return clean.unionByName(masked.drop(row, spans))
