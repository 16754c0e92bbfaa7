import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.functions.curve import CURVES, cover, key_column, keys, merge_intervals, scale, scale_value

TOP = 2**31 - 1


def grid(dims, bits):
    return np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij")).reshape(dims, -1)


def test_compat_golden_values():
    points = [(0, 0), (0, 1), (1, 0), (TOP, 0), (0, TOP), (TOP, TOP), (1 << 30, 1 << 30), (123456789, 987654321)]
    want = [0, 1, 3, 3458764513820540928, 1921535841011411626, 3074457345618258602, 2305843009213693952, 878081802465951678]
    a, b = (np.array([p[n] for p in points]) for n in (0, 1))
    assert keys(CURVES["compat2d"], [a, b]).tolist() == want
    assert keys(CURVES["compat2d"], list(grid(2, 2)), 2).reshape(4, 4).tolist() == [[0, 3, 7, 6], [1, 2, 4, 5], [13, 14, 8, 9], [12, 15, 11, 10]]


@pytest.mark.parametrize(("name", "bits"), [("hilbert2d", 5), ("compat2d", 5), ("hilbert3d", 3)])
def test_bijective_and_prefix_preserving(name, bits):
    curve = CURVES[name]
    g = grid(curve.dims, bits)
    k = keys(curve, list(g), bits)
    assert sorted(k.tolist()) == list(range(2 ** (bits * curve.dims)))
    coarse = keys(curve, list(g >> 1), bits - 1)
    assert (k >> curve.dims == coarse).all()
    if curve.corrected:
        steps = np.abs(np.diff(g[:, np.argsort(k)], axis=1)).sum(0)
        assert steps.max() == 1


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(sorted(CURVES)), st.data())
def test_cover_holds_the_box(name, data):
    curve = CURVES[name]
    box = []
    for _ in range(curve.dims):
        a, b = sorted(data.draw(st.integers(0, curve.top)) for _ in range(2))
        box.append((a, b))
    intervals = cover(curve, box)
    assert all(a <= b for a, b in intervals)
    assert all(x[1] + 1 < y[0] for x, y in zip(intervals, intervals[1:]))
    inside = np.array([[data.draw(st.integers(a, b)) for a, b in box] for _ in range(5)]).T
    for k in keys(curve, list(inside)).tolist():
        assert any(a <= k <= b for a, b in intervals)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)).map(lambda t: (t[0], t[0] + t[1]))))
def test_merge_intervals(intervals):
    def held(spans):
        return {x for a, b in spans for x in range(a, b + 1)}

    merged = merge_intervals(intervals)
    assert held(merged) == held(intervals)
    assert all(x[1] + 1 < y[0] for x, y in zip(merged, merged[1:]))


def test_scale_and_key_of_odd_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-5.0,), (0.0,), (10.0,), (99.0,), (5.0,)], "v double")
    got = [r[0] for r in df.select(scale(F.col("v"), 0, 10, 100)).collect()]
    assert got == [0, 0, 0, 0, 0, 100, 100, 50]
    assert [scale_value(v, 0, 10, 100) for v in (-5.0, 0.0, 5.0, 99.0)] == [0, 0, 50, 100]
    assert scale_value(3.0, 2, 2, 100) == 0
    keyed = df.select(key_column(CURVES["hilbert2d"], [F.col("v"), F.col("v")], [(0, 10), (0, 10)]).alias("k")).collect()
    assert all(r["k"] is not None and r["k"] >= 0 for r in keyed)
