"""Parsers from source values to typed fields. Unusable input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_fusion.functions.text import has_text, strip

# The JVM's double parser also takes "1d", "inf" and the like, so only text of
# this shape reaches it.
_PLAIN_DECIMAL = r"^(\d+\.?\d*|\.\d+)$"
_DECIMAL = r"(?U)^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"

# Date layouts accepted besides ISO 8601. Where day and month could be either, the
# month comes first, and the day where that gives no date.
_DATE_LAYOUTS = [
    (r"^\d{8}$", ["yyyyMMdd"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", ["yyyy.M.d"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["M/d/yyyy", "d/M/yyyy"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["M.d.yyyy", "d.M.yyyy"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["M-d-yyyy", "d-M-yyyy"]),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ["d MMM yyyy"]),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", ["d-MMM-yyyy"]),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", ["d MMMM yyyy"]),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ["MMM d, yyyy", "MMM d yyyy"]),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", ["MMMM d, yyyy", "MMMM d yyyy"]),
]
_ISO_DATE = (
    r"^\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"
)


def is_empty(value: Column, data_type: T.DataType) -> Column:
    """Null, NaN or a string of white space only; never null itself."""
    if isinstance(data_type, T.StringType):
        return value.isNull() | ~has_text(value)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def _to_double(text: Column, grammar: str) -> Column:
    """The number a text spells, evaluating the text once; null if it spells none."""
    return F.regexp_extract(text, grammar, 1).try_cast("double")


def parse_money(value: Column, data_type: T.DataType = T.StringType()) -> Column:
    """A positive amount; currency signs, letters and thousands commas are dropped."""
    if isinstance(data_type, T.NumericType):
        amount = value.cast("double")
        amount = F.when(~F.isnan(amount), amount)
    else:
        amount = _to_double(F.regexp_replace(value, r"[^0-9.\-]", ""), _PLAIN_DECIMAL)
    return F.when(amount > 0, amount)


def parse_int(
    value: Column,
    low: int | None = None,
    high: int | None = None,
    data_type: T.DataType = T.StringType(),
) -> Column:
    """A number truncated toward zero; null outside ``low..high``."""
    if isinstance(data_type, T.IntegralType):
        number = value.cast("bigint")
    elif isinstance(data_type, T.NumericType):
        number = value.cast("double").try_cast("bigint")
        number = F.when(~F.isnan(value.cast("double")), number)
    else:
        digits = F.regexp_replace(value, r",|(?<=\d)_(?=\d)", "")
        number = _to_double(digits, _DECIMAL).try_cast("bigint")
    return within(number, low, high)


def within(number: Column, low: float | None, high: float | None) -> Column:
    """The number if it lies in ``low..high``, else null; a missing bound is open."""
    inside = F.lit(True)
    if low is not None:
        inside &= number >= low
    if high is not None:
        inside &= number <= high
    return F.when(inside, number)


def parse_rating(
    value: Column,
    low: float | None = 0.0,
    high: float | None = 10.0,
    data_type: T.DataType = T.StringType(),
) -> Column:
    """A number within ``low..high``."""
    if isinstance(data_type, T.NumericType):
        number = value.cast("double")
    else:
        number = _to_double(value, _DECIMAL)
    return within(number, low, high)


def parse_date(value: Column, data_type: T.DataType = T.StringType()) -> Column:
    """A calendar date from ISO 8601 text or one of the further layouts."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("date")
    text = strip(value.cast("string"))
    parsed = F.when(text.rlike(_ISO_DATE), text).try_cast("date")
    for shape, layouts in _DATE_LAYOUTS:
        own = [F.try_to_date(text, layout) for layout in layouts]
        parsed = F.coalesce(parsed, F.when(text.rlike(shape), F.coalesce(*own)))
    return parsed


def fill_year(year: Column, release_date: Column) -> Column:
    """The given year, else the year of the release date."""
    return F.coalesce(year, F.year(release_date))


def parse_release_moment(value: Column) -> Column:
    """``date T time`` or ``date time``; a date alone stands for 19:00 that day."""
    text = F.replace(strip(value), F.lit(" "), F.lit("T"))
    dated = F.when(text.contains("T"), text).otherwise(F.concat(text, F.lit("T19:00:00")))
    return F.when(
        dated.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"),
        F.when(dated.rlike(r"T\d{2}$"), F.concat(dated, F.lit(":00"))).otherwise(dated),
    ).try_cast("timestamp_ntz")
