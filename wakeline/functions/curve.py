"""Space-filling curve keys for clustering and pruning.

A key is read off a small automaton, from the highest bit down: the state is how
the axes are swapped and flipped at this depth, one bit of every axis gives the next digit.  A
key's leading digits therefore name the enclosing cell, which makes intervals of keys usable
as covers of boxes.

``hilbert`` curves move to an adjacent cell at each step.  ``compat`` leaves out the last
correction: it is a bijection with the same prefix property, kept for layouts
that were written with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Curve:
    name: str
    dims: int
    bits: int
    corrected: bool

    @property
    def top(self) -> int:
        return (1 << self.bits) - 1


CURVES = {c.name: c for c in (Curve("hilbert2d", 2, 31, True), Curve("compat2d", 2, 31, False), Curve("hilbert3d", 3, 21, True))}


def keys(curve: Curve, axes: list[np.ndarray], depth: int | None = None) -> np.ndarray:
    """Keys of points whose axes are whole numbers of ``depth`` bits (all bits by default)."""
    depth = curve.bits if depth is None else depth
    points = np.stack([np.asarray(a, np.int64) for a in axes])
    source = np.tile(np.arange(curve.dims)[:, None], (1, points.shape[1]))  # which axis stands where
    flip = np.zeros_like(points)
    parity = np.zeros(points.shape[1], np.int64)
    out = np.zeros(points.shape[1], np.int64)
    for bit in range(depth - 1, -1, -1):
        seen = np.take_along_axis((points >> bit) & 1, source, 0) ^ flip
        for i in range(curve.dims):
            flip[0] ^= seen[i]
            if i:
                stay = seen[i] == 1
                for state in (source, flip):
                    state[0], state[i] = np.where(stay, state[0], state[i]), np.where(stay, state[i], state[0])
        digit = np.bitwise_xor.accumulate(seen, 0)
        last = digit[-1].copy()
        if curve.corrected:
            digit = digit ^ parity
            parity = parity ^ last
        for i in range(curve.dims):
            out = out << 1 | digit[i]
    return out


def scale(value: Column, low: float, high: float, top: int) -> Column:
    """A value's place on an axis of whole numbers from 0 to ``top``: clamped, rounded half up.

    Null and non-finite values, or an empty range, are 0.
    """
    v = value.cast("double")
    if not high > low:
        return F.lit(0).cast("long")
    share = F.least(F.greatest((v - F.lit(float(low))) / F.lit(float(high) - float(low)), F.lit(0.0)), F.lit(1.0))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(finite, F.floor(share * float(top) + 0.5)).otherwise(F.lit(0)).cast("long")


def scale_value(value: float, low: float, high: float, top: int) -> int:
    """What ``scale`` gives for one value."""
    if not high > low or not np.isfinite(value):
        return 0
    return int(np.floor(min(max((value - low) / (high - low), 0.0), 1.0) * top + 0.5))


def key_column(curve: Curve, values: list[Column], bounds: list[tuple[float, float]]) -> Column:
    """The curve key of each row."""

    @F.pandas_udf("bigint")
    def key2(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(keys(curve, [a.to_numpy(), b.to_numpy()]))

    @F.pandas_udf("bigint")
    def key3(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(keys(curve, [a.to_numpy(), b.to_numpy(), c.to_numpy()]))

    scaled = [scale(v, lo, hi, curve.top) for v, (lo, hi) in zip(values, bounds, strict=True)]
    return (key2 if curve.dims == 2 else key3)(*scaled)


def cover(curve: Curve, box: list[tuple[int, int]], most: int = 64) -> list[tuple[int, int]]:
    """Intervals of keys that hold all points of a box of whole numbers (ends included).

    Cells are split depth by depth until about ``most`` are open; a cell inside the box is not split.
    """
    open_, done = np.zeros((curve.dims, 1), np.int64), []
    lows, highs = (np.array([b[n] for b in box])[:, None] for n in (0, 1))
    for depth in range(curve.bits + 1):
        shift = curve.bits - depth
        first, last = open_ << shift, ((open_ + 1) << shift) - 1
        meets = ((last >= lows) & (first <= highs)).all(0)
        inside = ((first >= lows) & (last <= highs)).all(0) & meets
        ends = inside | (meets & ((depth == curve.bits) | (meets.sum() + len(done) >= most)))
        if ends.any():
            prefix = keys(curve, list(open_[:, ends]), depth) if depth else np.zeros(int(ends.sum()), np.int64)
            done += [(int(p) << (shift * curve.dims), ((int(p) + 1) << (shift * curve.dims)) - 1) for p in prefix]
        rest = open_[:, meets & ~ends]
        if not rest.shape[1]:
            break
        corners = np.stack(np.meshgrid(*[[0, 1]] * curve.dims, indexing="ij")).reshape(curve.dims, -1)
        open_ = (rest[:, :, None] * 2 + corners[:, None, :]).reshape(curve.dims, -1)
    return merge_intervals(done)


def merge_intervals(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals of whole numbers with the same union; neighbours are joined."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def key_sql(x: str, y: str, source: str, keep: str, bits: int = 31, corrected: bool = False) -> str:
    """DuckDB SQL for two-dimensional keys: columns ``keep`` and ``curve_key`` of ``source`` with whole-number axes x and y."""
    sql = f"SELECT {keep}, ({x})::BIGINT AS _x, ({y})::BIGINT AS _y, 0 AS _s, 0 AS _f, 0 AS _g, 0 AS _t, 0::BIGINT AS _k FROM {source}"
    for bit in range(bits - 1, -1, -1):
        sql = (
            f"SELECT *, xor(((CASE WHEN _s = 1 THEN _y ELSE _x END >> {bit}) & 1)::INT, _f) AS _a, "
            f"xor(((CASE WHEN _s = 1 THEN _x ELSE _y END >> {bit}) & 1)::INT, _g) AS _b FROM ({sql})"
        )
        turn = "xor(_t, xor(_a, _b))" if corrected else "0"
        sql = (
            f"SELECT {keep}, _x, _y, CASE WHEN _b = 1 THEN _s ELSE 1 - _s END AS _s, CASE WHEN _b = 1 THEN xor(xor(_f, _a), 1) ELSE _g END AS _f, "
            f"CASE WHEN _b = 1 THEN _g ELSE xor(_f, _a) END AS _g, {turn} AS _t, _k * 4 + xor(_a, _t) * 2 + xor(xor(_a, _b), _t) AS _k FROM ({sql})"
        )
    return f"SELECT {keep}, _k AS curve_key FROM ({sql})"


def key_sql_3d(axes: tuple[str, str, str], source: str, keep: str, bits: int = 21) -> str:
    """DuckDB SQL for three-dimensional keys, as ``key_sql``; the state is a column for each slot's axis and flip."""
    sql = ", ".join(f"({a})::BIGINT AS _x{n}, {n} AS _s{n}, 0 AS _f{n}" for n, a in enumerate(axes))
    sql = f"SELECT {keep}, {sql}, 0 AS _t, 0::BIGINT AS _k FROM {source}"
    points = "_x0, _x1, _x2"
    for bit in range(bits - 1, -1, -1):
        seen = ", ".join(f"xor(((CASE _s{n} WHEN 0 THEN _x0 WHEN 1 THEN _x1 ELSE _x2 END >> {bit}) & 1)::INT, _f{n}) AS _b{n}" for n in range(3))
        sql = f"SELECT *, {seen} FROM ({sql})"
        # A bit of 0 puts slots 0 and 1, and then 0 and 2, in each other's place.
        sql = (
            f"SELECT {keep}, {points}, _t, _k, _b0, _b1, _b2, _s2, _f2, CASE WHEN _b1 = 1 THEN _s0 ELSE _s1 END AS _s0, CASE WHEN _b1 = 1 THEN _s1 ELSE _s0 END AS _s1, "
            f"CASE WHEN _b1 = 1 THEN xor(_f0, xor(_b0, _b1)) ELSE _f1 END AS _f0, CASE WHEN _b1 = 1 THEN _f1 ELSE xor(_f0, xor(_b0, _b1)) END AS _f1 FROM ({sql})"
        )
        digits = "xor(_b0, _t) * 4 + xor(xor(_b0, _b1), _t) * 2 + xor(xor(xor(_b0, _b1), _b2), _t)"
        sql = (
            f"SELECT {keep}, {points}, _s1, _f1, CASE WHEN _b2 = 1 THEN _s0 ELSE _s2 END AS _s0, CASE WHEN _b2 = 1 THEN _s2 ELSE _s0 END AS _s2, "
            f"CASE WHEN _b2 = 1 THEN xor(_f0, _b2) ELSE _f2 END AS _f0, CASE WHEN _b2 = 1 THEN _f2 ELSE xor(_f0, _b2) END AS _f2, "
            f"xor(_t, xor(xor(_b0, _b1), _b2)) AS _t, _k * 8 + {digits} AS _k FROM ({sql})"
        )
    return f"SELECT {keep}, _k AS curve_key FROM ({sql})"
