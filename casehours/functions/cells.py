"""Cells of text exports and lists as expressions (T-01 to T-08, T-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a list writes for nothing.
BLANKS = ("", "na", "n/a", "null", "#n/a")
#: Spellings of a direction (blank is forward).
FORWARD = ("", "1", "+1", "+", "forward", "fwd", "f", "positive")
REVERSED = ("-1", "-", "reverse", "reversed", "rev", "r", "negative")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normalized(raw: Column) -> Column:
    """Trimmed, #..# unwrapped, a leading apostrophe off, blanks null (T-01)."""
    text = F.trim(raw)
    text = F.regexp_replace(text, r"^#(.*)#$", "$1")
    text = F.trim(F.regexp_replace(text, r"^'", ""))
    return F.when(~F.lower(F.trim(raw)).isin(*BLANKS) & ~F.lower(text).isin(*BLANKS), text)


def number(text: Column) -> Column:
    """A number with perhaps thousands commas, the whole cell, finite; else null (T-02)."""
    plain = F.regexp_replace(text, ",", "")
    value = F.when(plain.rlike(_NUMBER), plain.try_cast("double"))
    return F.when(F.abs(value) <= 1.7976931348623157e308, value)


def boolean(text: Column) -> Column:
    """true/yes/1, false/no/0, else null (T-03)."""
    low = F.lower(text)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def iso_date(text: Column) -> Column:
    """YYYY-MM-DD or YYYY/MM/DD at the beginning; a day that does not exist is null (T-04)."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})", 1), "/", "-"), F.lit("yyyy-M-d")).cast("date")


def zero_is_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0.0))


def value_cell(raw: Column) -> Column:
    """A value of an export: padding trimmed, exponents accepted, blank and unreadable null (T-05)."""
    text = F.trim(raw)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def value_is_bad(raw: Column) -> Column:
    """Neither blank nor a number."""
    return (F.trim(F.coalesce(raw, F.lit(""))) != "") & value_cell(raw).isNull()


def hour_ending(raw: Column) -> Column:
    """1 to 24, perhaps written 1.0; else null (T-06)."""
    he = F.regexp_extract(raw, r"^\s*(\d{1,2})(?:\.0*)?\s*$", 1).try_cast("int")
    return F.when(he.between(1, 24), he)


def time_of_use(raw: Column) -> Column:
    """OnPeak or OffPeak in any case and punctuation; else null (T-07)."""
    low = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[\s_-]", "")
    return F.when(low == "onpeak", "OnPeak").when(low == "offpeak", "OffPeak")


def export_date(raw: Column) -> Column:
    """M/D/YYYY, a midnight time may follow, the day must exist in its year; else null (T-08)."""
    part = lambda k: F.regexp_extract(raw, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+(?:0?0:00(?::00)?|12:00(?::00)?\s*AM))?\s*$", k)
    return F.try_to_timestamp(F.nullif(F.concat_ws("-", part(3), part(1), part(2)), F.lit("--")), F.lit("yyyy-M-d")).cast("date")


def direction(raw: Column) -> Column:
    """1 forward, -1 reversed, null refused (T-14)."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(low.isin(*FORWARD), 1).when(low.isin(*REVERSED), -1)

