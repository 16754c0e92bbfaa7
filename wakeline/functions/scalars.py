"""Scalar functions of the typed projection; a value that does not parse is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
_TIMESTAMP = r"^(\d{4}).(\d{2}).(\d{2}).(\d{2}).(\d{2}).(\d{2})"
_OFFSET = r"^.{19}([+-])(\d{2}):?(\d{2})?"


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def parse_long(c: Column) -> Column:
    """Whole numbers with an optional sign; no white space, no fraction."""
    return F.when(c.rlike(_INTEGER), c).try_cast("bigint")


def parse_float(c: Column) -> Column:
    """Single-precision numbers in plain or exponent form, inf and nan; no white space or type letters."""
    return F.when(F.lower(c).rlike(_FLOAT), c).try_cast("float")


def parse_imo(c: Column) -> Column:
    """The number after one leading ``IMO``, if there is one."""
    return parse_long(F.regexp_replace(c, "^IMO", ""))


def parse_class(c: Column) -> Column:
    return c == "B"


def parse_timestamp(c: Column, whole_hours: bool = False) -> Column:
    """UTC time of ``YYYY?MM?DD?HH?MM?SS`` with any separators and an optional ``+HH[[:]MM]`` right after the seconds.

    What follows otherwise, such as a fraction, is ignored.  ``whole_hours`` ignores an offset's minutes.
    """
    t = F.trim(c)
    part = [F.regexp_extract(t, _TIMESTAMP, n) for n in range(1, 7)]
    plain = F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit(" "), part[3], F.lit(":"), part[4], F.lit(":"), part[5])
    local = F.when(t.rlike(_TIMESTAMP), plain).try_cast("timestamp_ntz")
    hours = F.regexp_extract(t, _OFFSET, 2).try_cast("int")
    minutes = F.lit(0) if whole_hours else F.coalesce(F.regexp_extract(t, _OFFSET, 3).try_cast("int"), F.lit(0))
    away = F.when(F.regexp_extract(t, _OFFSET, 1) == "-", -1).otherwise(1) * (F.coalesce(hours, F.lit(0)) * 60 + minutes)
    return local - F.make_dt_interval(F.lit(0), F.lit(0), away)


def first_digit(c: Column) -> Column:
    """First decimal digit of a number; null for negative ones and nulls."""
    return F.substring(c.cast("string"), 1, 1).try_cast("int")


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def day_columns(ts: Column) -> dict[str, Column]:
    """The partition columns of a time."""
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)}
