"""Declarative queries over a track table: a conjunction of filters and one closing operation.

A filter is data, so planners can read it; ``where`` compiles the conjunction to a Column
that Catalyst pushes to the scan.  A null never matches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OneOf:
    """Equality with one value or any of several."""

    column: str
    values: tuple

    def compile(self) -> Column:
        return F.col(self.column) == self.values[0] if len(self.values) == 1 else F.col(self.column).isin(*self.values)


@dataclass(frozen=True)
class Range:
    """A numeric range in double precision; an open end is None, ends count unless told otherwise."""

    column: str
    low: float | None = None
    high: float | None = None
    low_closed: bool = True
    high_closed: bool = True

    def compile(self) -> Column:
        c = F.col(self.column).cast("double")
        sides = []
        if self.low is not None:
            sides.append(c >= float(self.low) if self.low_closed else c > float(self.low))
        if self.high is not None:
            sides.append(c <= float(self.high) if self.high_closed else c < float(self.high))
        return all_of(sides)


@dataclass(frozen=True)
class Between:
    """A half-open time range."""

    column: str
    start: datetime
    end: datetime

    def compile(self) -> Column:
        return (F.col(self.column) >= _moment(self.start)) & (F.col(self.column) < _moment(self.end))


@dataclass(frozen=True)
class Text:
    """Case-sensitive prefix or substring."""

    column: str
    value: str
    anywhere: bool = False

    def compile(self) -> Column:
        return F.col(self.column).contains(self.value) if self.anywhere else F.col(self.column).startswith(self.value)


def _moment(t: datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def parse_hour(text: str) -> datetime:
    """A time written as ``YYYY-MM-DD HH`` or ``YYYY-MM-DD``."""
    return datetime.strptime(text, "%Y-%m-%d %H" if " " in text else "%Y-%m-%d")


def all_of(parts: Iterable[Column | None]) -> Column:
    """Conjunction that leaves out None; true if nothing is left."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None] or [F.lit(True)])


def any_of(parts: Iterable[Column | None]) -> Column | None:
    """Disjunction that leaves out None; None if nothing is left."""
    kept = [p for p in parts if p is not None]
    return reduce(lambda a, b: a | b, kept) if kept else None


@dataclass(frozen=True)
class TrackQuery:
    """Filters and an operation: ``count``, ``rows``, ``groups`` (of ``column``), ``days`` or ``distinct``."""

    name: str = ""
    category: str = ""
    filters: tuple = ()
    operation: str = "count"
    column: str | None = None
    time_column: str = "BaseDateTime"
    notes: str = field(default="", compare=False)

    def _with(self, f) -> TrackQuery:
        return replace(self, filters=(*self.filters, f))

    def one_of(self, column: str, *values) -> TrackQuery:
        return self._with(OneOf(column, values))

    def between(self, column: str, low: float | None, high: float | None, low_closed: bool = True, high_closed: bool = True) -> TrackQuery:
        return self._with(Range(column, low, high, low_closed, high_closed))

    def box(self, lat: tuple[float, float], lon: tuple[float, float], lat_column: str = "LAT", lon_column: str = "LON") -> TrackQuery:
        return self.between(lat_column, *lat).between(lon_column, *lon)

    def during(self, start: str, end: str) -> TrackQuery:
        return self._with(Between(self.time_column, parse_hour(start), parse_hour(end)))

    def prefix(self, column: str, value: str) -> TrackQuery:
        return self._with(Text(column, value))

    def substring(self, column: str, value: str) -> TrackQuery:
        return self._with(Text(column, value, anywhere=True))

    def closing(self, operation: str, column: str | None = None) -> TrackQuery:
        return replace(self, operation=operation, column=column)

    def where(self) -> Column:
        return all_of(f.compile() for f in self.filters)

    def ranges(self, column: str) -> tuple[float, float] | None:
        """The intersection of the closed ranges of a column, None without any."""
        own = [f for f in self.filters if isinstance(f, Range) and f.column == column]
        if not own:
            return None
        lows, highs = [f.low for f in own if f.low is not None], [f.high for f in own if f.high is not None]
        return max(lows, default=float("-inf")), min(highs, default=float("inf"))

    def times(self) -> tuple[datetime, datetime] | None:
        own = [f for f in self.filters if isinstance(f, Between) and f.column == self.time_column]
        return (max(f.start for f in own), min(f.end for f in own)) if own else None

    def days(self) -> tuple[datetime, datetime] | None:
        """First and last day that a matching row can have."""
        t = self.times()
        return (t[0], t[1] - timedelta(microseconds=1)) if t else None

    def finish(self, matching: DataFrame) -> DataFrame:
        """The operation over matching rows: one row with ``n``, but the rows themselves for ``rows``."""
        if self.operation == "rows":
            return matching
        if self.operation == "count":
            return matching.agg(F.count(F.lit(1)).alias("n"))
        if self.operation == "days":
            return matching.agg(F.count_distinct(F.to_date(self.time_column)).alias("n"))
        if self.operation in ("groups", "distinct"):
            return matching.agg(F.count_distinct(self.column).alias("n"))
        raise ValueError(f"unknown operation {self.operation!r}")

    def run(self, df: DataFrame) -> DataFrame:
        return self.finish(df.where(self.where()))


def group_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def day_counts(df: DataFrame, time_column: str = "BaseDateTime") -> DataFrame:
    """Rows per UTC day, null times left out."""
    return df.where(F.col(time_column).isNotNull()).groupBy(F.to_date(time_column).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def semi_join(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose value is listed: the form of ``one_of`` for lists too long for a literal; Spark picks the join by size."""
    return df.join(ids.select(column).distinct(), column, "left_semi")
