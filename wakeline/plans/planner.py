"""Implied predicates: what a query's filters say about a layout's partition and curve columns.

Every predicate added here follows from the query, so results are the same with and
without; it only lets Spark prune partitions and row groups.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.curve import CURVES, cover, scale_value
from wakeline.operators.predicates import TrackQuery, all_of, any_of
from wakeline.sources.layouts import KEY, Layout

INTERVALS = 64  # about how many curve cells a box is covered with


def day_predicate(query: TrackQuery, layout: Layout) -> Column | None:
    """Days that rows in the query's time range can have."""
    days = query.days()
    if not layout.partitioned or days is None or query.time_column != layout.time_column:
        return None
    day = F.make_date("year", "month", "day")
    return (day >= F.lit(days[0].date())) & (day <= F.lit(days[1].date()))


def _micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def curve_predicate(query: TrackQuery, layout: Layout, intervals: int = INTERVALS) -> Column | None:
    """Curve intervals that cover the query's box; None if it has none or lies outside the layout's bounds."""
    if not layout.curve or not layout.bounds:
        return None
    curve, box, some = CURVES[layout.curve], [], False
    for axis, (low, high) in zip(layout.axes, layout.bounds, strict=True):
        own = query.ranges(axis)
        if axis == query.time_column and (span := query.times()):
            own = (_micros(span[0]), _micros(span[1]) - 1)
        some = some or own is not None
        a, b = max(low, own[0]) if own else low, min(high, own[1]) if own else high
        if a > b:
            return None  # rows out of bounds are clamped to them: no key interval is safe
        # An end at or beyond the bounds takes in the clamped rows; half a step of slack covers rounding.
        first = 0 if a <= low else max(0, scale_value(a, low, high, curve.top) - 1)
        last = curve.top if b >= high else min(curve.top, scale_value(b, low, high, curve.top) + 1)
        box.append((first, last))
    if not some:
        return None
    return any_of(F.col(KEY).between(a, b) for a, b in cover(curve, box, intervals))


def plan(df: DataFrame, query: TrackQuery, layout: Layout | None = None, intervals: int = INTERVALS) -> DataFrame:
    """The query over a layout's table, with implied predicates."""
    implied = [day_predicate(query, layout), curve_predicate(query, layout, intervals)] if layout else []
    return query.finish(df.where(all_of([*implied, query.where()])))


def describe(query: TrackQuery, layout: Layout) -> list[str]:
    """What a plan over a layout consists of: what its scan can skip by, the implied predicates and the query's own filters."""
    out = [layout.description]
    if day_predicate(query, layout) is not None:
        out.append("implied: days of the time range")
    if curve_predicate(query, layout) is not None:
        out.append("implied: curve intervals of the box")
    out += [f"filter: {type(f).__name__} on {f.column}" for f in query.filters]
    return [*out, f"operation: {query.operation}" + (f" of {query.column}" if query.column else "")]
