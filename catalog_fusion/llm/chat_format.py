"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one
role merged into a block, and the blocks concatenated:

    <s>role[INST]text[SEP]text[/INST]</s>

A backslash goes into every control string that a text or role holds, behind its
first bracket and any backslashes that follow it, and reading takes one out again.
So the output is read back exactly, merged turns included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, NEXT, CLOSE = "<s>", "[INST]", "[SEP]", "[/INST]</s>"
_NAMES = r"(/?(?:s>|INST\]|SEP\]))"
CONTROL = rf"([<\[]\\*){_NAMES}"
_ESCAPED = rf"([<\[]\\*)\\{_NAMES}"


def escape(text: Column) -> Column:
    """The text without control strings; ``unescape`` gives it back."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def format_chats(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_runs``.

    ``loss_runs`` is the loss mask over the code points of ``formatted`` as runs
    ``(chars, loss)``: markers and texts by turns, a marker first and last. Texts of
    the role ``learn`` are under the mask, markers never.

    Turns sort by ``turn`` (null first), then role, then text. Null roles and texts
    are empty, repeated rows are turns of their own, and rows with a null ``conv_id``
    form one conversation. An empty table gives no rows. A conversation is one output
    value, so it is held in one task, and nothing else is.
    """
    blank = F.lit("")
    turn = F.struct(
        F.col("turn"),
        escape(F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), blank)).alias("text"),
    )
    collected = (
        conversations.select("conv_id", turn.alias("one"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("one")).alias("turns"))
    )
    first = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    cut = collected.select("conv_id", "turns", first.alias("first"))
    blocks = F.transform(
        "first",
        lambda start, k: F.slice("turns", start + 1, F.coalesce(F.get("first", k + 1), F.size("turns")) - start),
    )
    merged = cut.select("conv_id", blocks.alias("blocks"))

    def head(block: Column) -> Column:
        return F.concat(F.lit(OPEN), F.get(block, F.lit(0))["role"], F.lit(BODY))

    def line(block: Column) -> Column:
        texts = F.array_join(F.transform(block, lambda t: t["text"]), NEXT)
        return F.concat(head(block), texts, F.lit(CLOSE))

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))

    def runs(block: Column, k: Column) -> Column:
        opening = F.char_length(head(block)) + F.when(k > 0, len(CLOSE)).otherwise(0)
        return F.flatten(
            F.transform(
                block,
                lambda t, i: F.array(
                    run(F.when(i == 0, opening).otherwise(len(NEXT)), F.lit(False)),
                    run(F.char_length(t["text"]), t["role"] == learn),
                ),
            )
        )

    return merged.select(
        "conv_id",
        F.array_join(F.transform("blocks", line), "").alias("formatted"),
        F.concat(
            F.flatten(F.transform("blocks", runs)), F.array(run(F.lit(len(CLOSE)), F.lit(False)))
        ).alias("loss_runs"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns that ``format_chats`` wrote: ``turns`` of ``(role, text, loss)``.

    ``loss`` comes from the mask: the run of the same place as the text.
    """

    def texts(block: Column) -> Column:
        role = unescape(F.substr(F.substring_index(block, BODY, 1), F.lit(len(OPEN) + 1)))
        body = F.substring_index(F.substring_index(block, BODY, -1), CLOSE.removesuffix("</s>"), 1)
        return F.transform(
            F.split(body, r"\[SEP\]", -1),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    lines = F.split("formatted", "</s>", -1)
    turns = F.flatten(F.transform(F.slice(lines, 1, F.size(lines) - 1), texts))
    masks = F.filter("loss_runs", lambda _, i: i % 2 == 1)
    both = F.zip_with(turns, masks, lambda t, m: F.struct(t["role"], t["text"], m["loss"]))
    return formatted.select("conv_id", both.alias("turns"), "formatted")
