import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as some

from streamtable import float64, int64
from streamtable.errors import DataTypeError, ShapeError
from streamtable.operators import tensor as tn


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def get(x):
        if isinstance(x, tn.Tensor):
            return np.array(one.select(x.column().alias("a")).first()[0], dtype=object).reshape(x.shape).tolist()
        return one.select(x.alias("a")).first()[0]

    return get


A = np.arange(1, 7).reshape(2, 3)
X = np.arange(1, 19).reshape(3, 2, 3)


def test_fixtures(value):
    a, b = tn.literal(A), tn.literal([[1, 2, 3, 4], [5, 6, 7, 8]])
    c = tn.literal([[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert value(a.invert_axis(0)) == [[4, 5, 6], [1, 2, 3]]
    assert value(a.invert_axis(1)) == [[3, 2, 1], [6, 5, 4]]
    for n in (2, -1, 5):
        assert value(c.roll(0, n)) == [[4, 5, 6], [7, 8, 9], [1, 2, 3]]
    assert value(c.roll(-1, 1)) == [[3, 1, 2], [6, 4, 5], [9, 7, 8]]
    assert value(b.slice_axis(1, None, 2)) == [[1, 2], [5, 6]]
    assert value(b.slice_axis(1, 2)) == [[3, 4], [7, 8]]
    assert value(b.slice_axis(1, 1, -2)) == [[2], [6]]
    assert value(b.slice_axis(0, 1)) == [[5, 6, 7, 8]]
    assert value(b.slice(slice(None, 1), slice(1, 3))) == [[2, 3]]
    assert value(b.slice(tn.NEW_AXIS, slice(None, None, -1), slice(0, 3, 2))) == [[[5, 7], [1, 3]]]


def test_stack_and_concat(value):
    x = tn.literal(X)
    for axis in range(3):
        assert value(tn.stack(axis, x.unstack(axis))) == X.tolist()
        assert value(tn.concat(axis, [x.collapse_axis(axis, k) for k in range(x.shape[axis])])) == X.tolist()
    rows = [x.slice(slice(None), k) for k in range(2)]
    assert value(tn.stack(-1, rows)) == X.swapaxes(1, 2).tolist()
    assert value(tn.concat(2, [x.slice_axis(2, 0, 2), x.slice_axis(2, 2, 3)])) == X.tolist()
    assert value(tn.concat(-1, rows)) == X.reshape(3, 6).tolist()
    with pytest.raises(ShapeError):
        tn.concat(0, [])
    with pytest.raises(ShapeError):
        tn.stack(0, [x, tn.literal(A)])


def test_numbers(value):
    a = tn.literal([7, -7, 0])
    assert value(a / 2) == [3, -3, 0] and value(a % 3) == [1, -1, 0]
    assert value(tn.literal([1.0, -1.0]) / 0.0) == [float("inf"), float("-inf")]
    assert np.isnan(value(tn.literal([0.0]) / 0.0)[0])
    assert value(tn.linspace(0, 10, 4)) == [0, 2.5, 5, 7.5] and value(tn.arange(5, 1)) == [5] and value(tn.arange(0, 7, 3)) == [0, 3, 6]
    assert value(tn.literal([True, False]) & True) == [True, False]
    assert value(tn.literal([6]) ^ 3) == [5]
    with pytest.raises(DataTypeError):
        tn.literal(["a"]) + 1
    with pytest.raises(DataTypeError):
        tn.literal([1]).sin()


def test_masks(value):
    m = tn.literal(np.ma.masked_array([1.0, 2.0, 3.0], [0, 1, 0]))
    assert value(m + 1) == [2.0, None, 4.0] and value(m.fill_masked(0.0)) == [1.0, 0.0, 3.0] and value(m.compress()) == [1.0, 3.0]
    assert value(m.mask()) == [True, False, True] and value(m.num_valid()) == 2 and value(m.sum()) == 4.0
    assert value(tn.literal([1, 2, 3]).with_mask(tn.literal([True, False, True]))) == [1, None, 3]
    assert value(m.gt(0.5).all()) is True and value(m.gt(2.5).any()) is True
    text = tn.literal(["A", "B", "C"]).eq(tn.literal(np.ma.masked_array(["A", "x", "B"], [0, 1, 0])))
    assert value(text) == [True, None, False]
    assert value(tn.literal([1, 2]).lt(2)) == [True, False] and value(tn.literal([1, 2]).lte(2)) == [True, True]


def test_shapes(value):
    x = tn.literal(A)
    assert value(x.reshape(3, 2).t().diag()) == [1, 4] and value(x.index(-1, -1)) == 6
    assert x.unsqueeze(-1).shape == (2, 3, 1) and x.unsqueeze(0).squeeze(0).shape == (2, 3)
    assert value(x.broadcast_to((2, 2, 3))) == [A.tolist()] * 2
    assert value(x.slice_axis(0, 2, 1)) == []
    assert value(tn.literal(5.0).scalar()) == 5.0
    for bad in (lambda: x.reshape(4), lambda: x.index(2, 0), lambda: x.broadcast_to((3, 2)), lambda: x + tn.literal([1, 2]), lambda: x.squeeze(0), lambda: x.index_axis(2, 0)):
        with pytest.raises(ShapeError):
            bad()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(some.lists(some.integers(1, 4), min_size=1, max_size=3), some.data())
def test_against_numpy(value, shape, data):
    n = int(np.prod(shape))
    a = np.arange(n).reshape(shape)
    t = tn.literal(a)
    for _ in range(data.draw(some.integers(1, 4))):
        axis = data.draw(some.integers(0, a.ndim - 1))
        step = data.draw(some.sampled_from(["flip", "roll", "swap", "slice", "new"]))
        k = data.draw(some.integers(-3, 3))
        if step == "flip":
            a, t = np.flip(a, axis), t.invert_axis(axis)
        elif step == "roll":
            a, t = np.roll(a, k, axis), t.roll(axis, k)
        elif step == "swap":
            a, t = a.swapaxes(axis, 0), t.swap_axes(axis, 0)
        elif step == "slice":
            a, t = a[(slice(None),) * axis + (slice(0, max(1, a.shape[axis] - 1)),)], t.slice_axis(axis, 0, max(1, a.shape[axis] - 1))
        elif a.ndim < 5:
            a, t = np.expand_dims(a, axis), t.unsqueeze(axis)
    assert value(t) == a.tolist()
    assert value(t.map(lambda x: x, float64) * t.map(lambda x: x, int64)) == (a * a).astype(float).tolist()


def test_wide_columns(spark):
    df = spark.range(3).selectExpr("id", "transform(sequence(0, 511), i -> CAST(i AS FLOAT)) AS v")
    out = tn.Tensor.of(df, "v", (16, 32)).t().invert_axis(0)
    got = df.select(out.alias("w")).first().w
    assert got == np.arange(512).reshape(16, 32).T[::-1].ravel().tolist()
    assert df.select(out.alias("w")).schema["w"].metadata["tensor_shape"] == [32, 16]


def test_drop_mask(spark):
    """What a mask hides comes back, after changes of shape too, and for a mask that is broader than the tensor."""
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "x array<int>")
    t = tn.Tensor.of(df, "x", (2, 3))
    masked = t.with_mask(t.gt(3))
    first = lambda x: df.select(x.column()).first()[0]
    assert first(masked) == [None, None, None, 4, 5, 6] and first(masked.drop_mask()) == [1, 2, 3, 4, 5, 6]
    assert first(masked.t().slice_axis(0, 1, 3).drop_mask()) == [2, 5, 3, 6] and masked.t().drop_mask().shape == (3, 2)
    wide = t.index_axis(0, 0).with_mask(t.gt(4))
    assert first(wide) == [None, None, None, None, 2, 3] and first(wide.drop_mask()) == [1, 2, 3, 1, 2, 3] and first(t.drop_mask()) == first(t)
