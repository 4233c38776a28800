"""Film requests: aliases, defaults, validation and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_fusion.functions.text import has_text

# Request fields with their aliases and defaults, and the defaults
# of requests that arrive as JSON.
FIELD_ALIASES = {
    "release_date": "release",
    "release_hour": "hour",
    "runtime_min": "runtime",
    "budget_usd": "budget",
    "cast": "actors",
}
FIELD_TYPES = {
    "title": "string",
    "year": "int",
    "release_date": "string",
    "release_hour": "int",
    "runtime_min": "int",
    "budget_usd": "double",
    "genres": "string",
    "director": "string",
    "cast": "string",
    "language": "string",
    "country": "string",
    "vote_count": "int",
}
FIELD_DEFAULTS = {
    "title": "Untitled",
    "release_hour": 19,
    "genres": "",
    "director": "",
    "cast": "",
    "language": "",
    "country": "",
}
JSON_DEFAULTS = {
    "release_hour": 19,
    "director": "",
    "cast": "",
    "genres": "Drama",
    "runtime_min": 120,
    "language": "tr",
    "country": "TR",
    "top_n": 8,
}
JSON_TYPES = {
    "title": "string",
    "release_date": "string",
    "release_hour": "int",
    "director": "string",
    "cast": "string",
    "genres": "string",
    "budget_usd": "double",
    "runtime_min": "int",
    "language": "string",
    "country": "string",
    "window_start": "string",
    "window_end": "string",
    "top_n": "int",
}
JSON_REQUIRED = ("title", "release_date")
# An explicit null is a value of these fields, and an error in the others.
JSON_NULLABLE = ("budget_usd", "runtime_min")
SLOT_HOURS = (14, 16, 18, 19, 20, 21)
TOP_N = 8
# End of fixed values.

# Slots that one task generates, scores and sorts, at most.
TASK_SLOTS = 500_000


def conform_requests(df: DataFrame) -> DataFrame:
    """Requests with every field the features need; other columns are kept.

    A field is taken from its own column, else from its alias, else from its
    default. A missing year is read from the start of the release date.
    """

    def given(name: str) -> Column:
        names = [c for c in (name, FIELD_ALIASES.get(name)) if c in df.columns]
        values = [F.col(f"`{c}`").try_cast(FIELD_TYPES[name]) for c in names]
        if name in FIELD_DEFAULTS:
            values.append(F.lit(FIELD_DEFAULTS[name]))
        return F.coalesce(*values) if values else F.lit(None).cast(FIELD_TYPES[name])

    fields = {name: given(name) for name in FIELD_TYPES}
    fields["release_date"] = F.when(has_text(fields["release_date"]), fields["release_date"])
    stated = F.when(fields["year"] != 0, fields["year"])
    fields["year"] = F.coalesce(stated, F.substring(fields["release_date"], 1, 4).try_cast("int"))
    others = [c for c in df.columns if c not in fields and c not in FIELD_ALIASES.values()]
    return df.select(
        *[F.col(f"`{c}`") for c in others], *[column.alias(name) for name, column in fields.items()]
    )


def _json_value(value: Column, kind: str) -> tuple[Column, Column]:
    """A variant as ``kind``, and whether it has such a value.

    Numeric text and numbers without a fraction are whole numbers; text is only
    text. An explicit null has no value.
    """
    shape = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    if kind == "string":
        return F.when(shape == "STRING", text), shape == "STRING"
    text = F.when(shape == "BOOLEAN", F.try_variant_get(value, "$", "int").cast("string")).otherwise(F.trim(text))
    number = F.when(~shape.rlike("^(OBJECT|ARRAY)"), text).try_cast("double")
    number = F.when(F.abs(number) < float("inf"), number)
    if kind == "int":
        number = F.when(number == F.floor(number), number).try_cast("int")
    return number, number.isNotNull()


_KIND_NAMES = {"string": "text", "int": "a whole number", "double": "a number"}


def parse_json_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per JSON body: its fields with defaults, and ``reject_reason``.

    The reason is null for a valid request, and else names the first field that is
    missing or has a value of the wrong type. Nothing is dropped. Values that are
    left out take their default; a value that cannot be read is null.
    """
    parsed = df.withColumn("_request", F.try_parse_json(F.col(body)))
    parts = {n: F.try_variant_get("_request", f"$.{n}", "variant").alias(f"_raw_{n}") for n in JSON_TYPES}
    parsed = parsed.select("*", *parts.values())
    fields, reason = {}, F.lit(None).cast("string")
    for name, kind in reversed(JSON_TYPES.items()):
        raw = F.col(f"_raw_{name}")
        null = F.coalesce(F.is_variant_null(raw), F.lit(False))
        value, usable = _json_value(raw, kind)
        wrong = raw.isNotNull() & ~F.coalesce(usable, F.lit(False))
        if name in JSON_NULLABLE:
            wrong = wrong & ~null
        if name in JSON_DEFAULTS:
            value = F.when(raw.isNull(), F.lit(JSON_DEFAULTS[name])).otherwise(value)
        fields[name] = value.cast(kind)
        reason = F.when(wrong, f"{name} must be {_KIND_NAMES[kind]}").otherwise(reason)
        if name in JSON_REQUIRED:
            reason = F.when(raw.isNull(), f"{name} is required").otherwise(reason)
        if name == "title":
            reason = F.when(F.length(value) < 1, "title is required").otherwise(reason)
        if name == "top_n":
            reason = F.when(value < 1, "top_n must be at least 1").otherwise(reason)
    fields = {name: fields[name] for name in JSON_TYPES}
    return parsed.withColumns(fields | {"reject_reason": reason}).drop("_request", *[f"_raw_{n}" for n in JSON_TYPES])


def window_error(start: str = "window_start", end: str = "window_end") -> Column:
    """Why a window cannot be used: null if it can. Its ends are compared as dates."""
    first, last = (F.col(c).try_cast("date") for c in (start, end))
    return (
        F.when(F.col(start).isNull() | F.col(end).isNull(), "a window is required")
        .when(first.isNull() | last.isNull(), "the window is not two dates")
        .when(last < first, "the window ends before it starts")
    )


def spread_rows(df: DataFrame, rows: Column, per_task: int) -> DataFrame:
    """``df`` dealt out evenly, so that tasks hold at most about ``per_task`` of what ``rows`` adds up to.

    For small input whose rows cost much: its bytes alone would give it a task or two.
    """
    tasks = -(-(df.agg(F.sum(rows)).first()[0] or 0) // per_task)
    return df.repartition(tasks) if tasks > 1 else df


def spread_requests(
    df: DataFrame, start: str = "window_start", end: str = "window_end", hours: tuple[int, ...] = SLOT_HOURS
) -> DataFrame:
    """Requests dealt out by the slots of their windows."""
    days = F.date_diff(F.col(end).try_cast("date"), F.col(start).try_cast("date")) + 1
    return spread_rows(df, (F.greatest(days, F.lit(0)) * len(hours)).cast("bigint"), TASK_SLOTS)


def slot_grid(
    df: DataFrame,
    start: str = "window_start",
    end: str = "window_end",
    hours: tuple[int, ...] = SLOT_HOURS,
    distinct: bool = False,
) -> DataFrame:
    """One row per request, day of its window and hour.

    Generated per request without a join; ``spread_requests`` before it bounds the slots of
    a task. A window that cannot be used is an error. With ``distinct``, only the first day
    of each month and weekday in the window: the others have the same calendar, see
    ``same_calendar``.
    """
    first, last = F.col(start).try_cast("date"), F.col(end).try_cast("date")
    wrong = window_error(start, end)
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(last)
    window = F.sequence(first, checked)
    if distinct:
        window = F.filter(window, lambda day: (F.date_sub(day, 7) < first) | (F.month(F.date_sub(day, 7)) != F.month(day)))
    days = df.withColumn("_day", F.explode(window))
    slots = days.select("*", F.posexplode(F.array(*[F.lit(h) for h in hours])).alias("hour_pos", "_hour"))
    return slots.withColumns(
        {
            "release_date": F.date_format("_day", "yyyy-MM-dd"),
            "release_hour": F.col("_hour"),
            "year": F.year("_day"),
            "weekday": F.date_format("_day", "EEEE"),
        }
    ).drop("_day", "_hour")


def same_calendar(slots: DataFrame, end: str = "window_end") -> DataFrame:
    """Every day of the window with the month and weekday of a slot's day, the first of them."""
    day = F.col("release_date").cast("date")
    last = F.least(F.col(end).try_cast("date"), F.last_day(day))
    days = slots.withColumn("_day", F.explode(F.sequence(day, last, F.expr("interval 7 days"))))
    return days.withColumn("release_date", F.date_format("_day", "yyyy-MM-dd")).drop("_day")
