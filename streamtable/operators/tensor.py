"""Tensor columns: fixed-shape arrays as expressions.

A tensor is an array column in row-major order with a shape known when the plan is made. Operations on shape only say where each
element comes from, so they are composed in Python into one index list, and a single `transform` gathers it when values are
needed; reshaping costs nothing. Elementwise operations are `transform` and `zip_with`, so everything stays an expression that
Spark plans, prunes and runs in the JVM. Null elements are the mask: any operation with a null is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtable.errors import DataTypeError, ShapeError
from streamtable.types import LOGICAL_KEY, SHAPE_KEY, DType, bool_, dtype_of, float64, int64, string

#: As numpy.newaxis, in slice().
NEW_AXIS = None
_RANK = {"bool": 0, "int8": 1, "uint8": 2, "int16": 3, "uint16": 4, "int32": 5, "uint32": 6, "int64": 7, "duration": 7, "uint64": 8, "float32": 9, "float64": 10}


class Tensor:
    """A tensor in each row: array, shape, element type, and the elements of the array that it is made of (None: all in order)."""

    def __init__(self, array: Column, shape: Sequence[int], dtype: DType, index: np.ndarray | None = None):
        self._array, self.shape, self.dtype = array, tuple(int(n) for n in shape), dtype
        self._index = index
        self._hidden: Tensor | None = None  # what a mask was put on, in the order of the array

    def __repr__(self) -> str:
        return f"Tensor({self.dtype}, {self.shape})"

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    # Into and out of DataFrames

    @classmethod
    def of(cls, df: DataFrame, name: str, shape: Sequence[int] | None = None) -> "Tensor":
        """The column of a DataFrame; its shape comes from its metadata if it isn't given."""
        field = df.schema[name]
        shape = shape or field.metadata.get(SHAPE_KEY)
        if not isinstance(field.dataType, T.ArrayType):
            return cls(F.array(F.col(f"`{name}`")), (), dtype_of(field.dataType, field.metadata))
        if shape is None:
            raise ShapeError(f"{name} has no shape")
        return cls(F.col(f"`{name}`"), shape, dtype_of(field.dataType, field.metadata))

    def column(self) -> Column:
        """The values as an array in row-major order."""
        if self._index is None:
            return self._array
        at = self._index.ravel()
        if len(at) and (np.diff(at) == 1).all():
            return F.slice(self._array, int(at[0]) + 1, len(at))
        if not len(at):
            return F.slice(self._array, 1, 0)
        array = self._array
        # A row-level null stays null.
        return F.when(array.isNotNull(), F.transform(F.lit([int(k) for k in at]), lambda k: F.get(array, k)))

    def alias(self, name: str) -> Column:
        """The column with its shape in its metadata."""
        return self.column().alias(name, metadata={SHAPE_KEY: list(self.shape), LOGICAL_KEY: self.dtype.name})

    def scalar(self) -> Column:
        """The value of a tensor of one element."""
        if self.size != 1:
            raise ShapeError(f"{self.shape} is not one element")
        return F.get(self.column(), F.lit(0))

    def elements(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows of (keys, idx, value), in row-major order."""
        return df.select(*keys, F.posexplode(self.column()).alias("idx", "value"))

    def valid_elements(self, df: DataFrame, *keys: str) -> DataFrame:
        return self.elements(df, *keys).where(F.col("value").isNotNull())

    # Shape

    def _places(self) -> np.ndarray:
        return (np.arange(self.size) if self._index is None else self._index).reshape(self.shape)

    def _gather(self, places: np.ndarray) -> "Tensor":
        out = Tensor(self._array, places.shape, self.dtype, places)
        out._hidden = self._hidden
        return out

    def _axis(self, axis: int, room: int = 0) -> int:
        n = self.rank + room
        if not -n <= axis < n:
            raise ShapeError(f"there is no axis {axis} in {self.shape}")
        return axis % n

    def _at(self, axis: int, k: int) -> int:
        n = self.shape[axis]
        if not -n <= k < n:
            raise ShapeError(f"{k} is out of range on axis {axis} of {self.shape}")
        return k % n

    def reshape(self, *shape: int) -> "Tensor":
        shape = tuple(shape[0]) if len(shape) == 1 and not isinstance(shape[0], int) else shape
        if math.prod(shape) != self.size:
            raise ShapeError(f"{self.shape} can't become {shape}")
        return Tensor(self._array, shape, self.dtype, self._index)

    def flatten(self) -> "Tensor":
        return self.reshape(self.size)

    def unsqueeze(self, axis: int) -> "Tensor":
        k = self._axis(axis, 1)
        return self.reshape(*self.shape[:k], 1, *self.shape[k:])

    def squeeze(self, axis: int) -> "Tensor":
        k = self._axis(axis)
        if self.shape[k] != 1:
            raise ShapeError(f"axis {axis} of {self.shape} is not 1 long")
        return self.reshape(*self.shape[:k], *self.shape[k + 1 :])

    def swap_axes(self, a: int, b: int) -> "Tensor":
        return self._gather(self._places().swapaxes(self._axis(a), self._axis(b)))

    def t(self) -> "Tensor":
        if self.rank != 2:
            raise ShapeError(f"{self.shape} is not a matrix")
        return self.swap_axes(0, 1)

    def broadcast_to(self, shape: Sequence[int]) -> "Tensor":
        if tuple(shape) == self.shape:
            return self
        try:
            return self._gather(np.broadcast_to(self._places(), tuple(shape)))
        except ValueError:
            raise ShapeError(f"{self.shape} can't be broadcast to {tuple(shape)}") from None

    def broadcast_with(self, other: "Tensor") -> tuple["Tensor", "Tensor"]:
        try:
            shape = np.broadcast_shapes(self.shape, other.shape)
        except ValueError:
            raise ShapeError(f"{self.shape} and {other.shape} can't be broadcast") from None
        return self.broadcast_to(shape), other.broadcast_to(shape)

    def invert_axis(self, axis: int) -> "Tensor":
        return self._gather(np.flip(self._places(), self._axis(axis)))

    def roll(self, axis: int, n: int) -> "Tensor":
        return self._gather(np.roll(self._places(), n, self._axis(axis)))

    def to_standard_layout(self) -> "Tensor":
        """The same values gathered into an array of their own."""
        return Tensor(self.column(), self.shape, self.dtype)

    def is_standard_layout(self) -> bool:
        return self._index is None

    # Index and slice

    def index(self, *at: int) -> Column:
        """One element."""
        if len(at) != self.rank:
            raise ShapeError(f"{len(at)} indices for {self.shape}")
        return F.get(self._array, F.lit(int(self._places()[tuple(self._at(a, k) for a, k in enumerate(at))])))

    def index_axis(self, axis: int, k: int) -> "Tensor":
        axis = self._axis(axis)
        return self._gather(self._places().take(self._at(axis, k), axis))

    def collapse_axis(self, axis: int, k: int) -> "Tensor":
        axis = self._axis(axis)
        return self._gather(self._places().take([self._at(axis, k)], axis))

    def slice_axis(self, axis: int, start: int | None = None, end: int | None = None, step: int = 1) -> "Tensor":
        """[start, end) of an axis; a negative step takes the same part and walks it from its end."""
        axis = self._axis(axis)
        places = self._places()
        kept = _range(self.shape[axis], slice(start, end, step))
        return self._gather(places.take(kept, axis))

    def slice(self, *parts: int | slice | None) -> "Tensor":
        """For each axis an index, a slice(start, end, step), or NEW_AXIS for a new one; axes that are left out stay whole."""
        places, axis = self._places(), 0
        for p in parts:
            if p is NEW_AXIS:
                places = np.expand_dims(places, axis)
                axis += 1
                continue
            if axis >= places.ndim:
                raise ShapeError(f"too many parts for {self.shape}")
            n = places.shape[axis]
            if isinstance(p, slice):
                places = places.take(_range(n, p), axis)
                axis += 1
            else:
                if not -n <= p < n:
                    raise ShapeError(f"{p} is out of range for {n}")
                places = places.take(p % n, axis)
        return self._gather(places)

    def diag(self) -> "Tensor":
        """The elements whose indices on all axes are one number."""
        n = min(self.shape)
        return self._gather(self._places()[tuple(np.arange(n) for _ in self.shape)])

    def unstack(self, axis: int) -> list["Tensor"]:
        axis = self._axis(axis)
        return [self.index_axis(axis, k) for k in range(self.shape[axis])]

    axis_iter = unstack

    # Elementwise

    def map(self, f: Callable[[Column], Column], dtype: DType | None = None) -> "Tensor":
        """f of each element, as a column expression. dtype: of the results, if it differs."""
        dtype = dtype or self.dtype
        return Tensor(F.transform(self.column(), lambda x: f(x).cast(dtype.spark)), self.shape, dtype)

    def _with(self, other, f: Callable[[Column, Column], Column], dtype: DType | None = None, swap: bool = False) -> "Tensor":
        if isinstance(other, Tensor):
            a, b = self.broadcast_with(other)
            dtype = dtype or _wider(a.dtype, b.dtype)
            g = (lambda x, y: f(y, x)) if swap else f
            return Tensor(F.zip_with(a.column(), b.column(), lambda x, y: g(x, y).cast(dtype.spark)), a.shape, dtype)
        value = other if isinstance(other, Column) else F.lit(other)
        if dtype is None:
            dtype = float64 if isinstance(other, float) and self.dtype.kind == "int" else self.dtype
        return self.map((lambda x: f(value, x)) if swap else (lambda x: f(x, value)), dtype)

    def _number(self, other) -> None:
        for t in (self, other):
            if isinstance(t, Tensor) and t.dtype.kind not in ("int", "float"):
                raise DataTypeError(f"{t.dtype} is not a number")

    def __add__(self, o):
        self._number(o)
        return self._with(o, lambda x, y: x + y)

    def __radd__(self, o):
        self._number(o)
        return self._with(o, lambda x, y: x + y, swap=True)

    def __sub__(self, o):
        self._number(o)
        return self._with(o, lambda x, y: x - y)

    def __rsub__(self, o):
        self._number(o)
        return self._with(o, lambda x, y: x - y, swap=True)

    def __mul__(self, o):
        self._number(o)
        return self._with(o, lambda x, y: x * y)

    __rmul__ = __mul__

    def _whole(self, o) -> bool:
        return self.dtype.kind == "int" and (o.dtype.kind == "int" if isinstance(o, Tensor) else isinstance(o, int))

    def __truediv__(self, o):
        self._number(o)
        return self._with(o, _whole_division if self._whole(o) else _division)

    def __rtruediv__(self, o):
        self._number(o)
        return self._with(o, _whole_division if self._whole(o) else _division, swap=True)

    def __mod__(self, o):
        self._number(o)
        return self._with(o, (lambda x, y: x % y) if self._whole(o) else _remainder)

    def __rmod__(self, o):
        self._number(o)
        return self._with(o, (lambda x, y: x % y) if self._whole(o) else _remainder, swap=True)

    def __neg__(self):
        self._number(None)
        return self.map(lambda x: -x)

    def _bits(self, o, on_int, on_bool) -> "Tensor":
        kinds = {self.dtype.kind, *([o.dtype.kind] if isinstance(o, Tensor) else [])}
        if kinds == {"bool"}:
            return self._with(o, on_bool)
        if kinds != {"int"}:
            raise DataTypeError("bitwise operations take whole numbers or booleans")
        return self._with(o, lambda x, y: on_int(x, y))

    def __and__(self, o):
        # Null if either is, unlike SQL's AND and OR.
        return self._bits(o, lambda x, y: x.bitwiseAND(y), lambda x, y: F.when(x.isNotNull() & y.isNotNull(), x & y))

    def __or__(self, o):
        return self._bits(o, lambda x, y: x.bitwiseOR(y), lambda x, y: F.when(x.isNotNull() & y.isNotNull(), x | y))

    def __xor__(self, o):
        return self._bits(o, lambda x, y: x.bitwiseXOR(y), lambda x, y: x != y)

    def atan2(self, o) -> "Tensor":
        self._float()
        return self._with(o, F.atan2)

    def _float(self) -> None:
        if self.dtype.kind != "float":
            raise DataTypeError(f"{self.dtype} is not a float")

    def _unary(self, f) -> "Tensor":
        self._float()
        return self.map(f)

    def sin(self):
        return self._unary(F.sin)

    def cos(self):
        return self._unary(F.cos)

    def tan(self):
        return self._unary(F.tan)

    def asin(self):
        return self._unary(F.asin)

    def acos(self):
        return self._unary(F.acos)

    def atan(self):
        return self._unary(F.atan)

    def exp(self):
        return self._unary(F.exp)

    def exp2(self):
        return self._unary(lambda x: F.pow(F.lit(2.0), x))

    def ln(self):
        return self._unary(lambda x: _logarithm(x, F.ln))

    def log2(self):
        return self._unary(lambda x: _logarithm(x, F.log2))

    def log10(self):
        return self._unary(lambda x: _logarithm(x, F.log10))

    def abs(self):
        self._number(None)
        return self.map(F.abs)

    # Compare

    def eq(self, o):
        return self._with(o, lambda x, y: x == y, bool_)

    def ne(self, o):
        return self._with(o, lambda x, y: x != y, bool_)

    def lt(self, o):
        return self._with(o, lambda x, y: x < y, bool_)

    def gt(self, o):
        return self._with(o, lambda x, y: x > y, bool_)

    def lte(self, o):
        return self._with(o, lambda x, y: x <= y, bool_)

    def gte(self, o):
        return self._with(o, lambda x, y: x >= y, bool_)

    # Masks: true is valid

    def mask(self) -> "Tensor":
        return Tensor(F.transform(self.column(), lambda x: x.isNotNull()), self.shape, bool_)

    def with_mask(self, mask: "Tensor") -> "Tensor":
        """Null where the mask is not true."""
        out = self._with(mask, lambda x, m: F.when(m, x), self.dtype)
        out._hidden = self.broadcast_to(out.shape)
        return out

    def drop_mask(self) -> "Tensor":
        """The values as they were before with_mask(), after whatever changes of shape there were since."""
        if self._hidden is None:
            return self
        return self._hidden._gather(self._hidden._places().ravel()[self._places()])

    def fill_masked(self, value) -> "Tensor":
        return self.map(lambda x: F.coalesce(x, F.lit(value)))

    def compress(self) -> Column:
        """The valid values, as many as there are in each row."""
        return F.filter(self.column(), lambda x: x.isNotNull())

    def nullable(self) -> "Tensor":
        return self

    def all(self) -> Column:
        """Whether no valid element is false."""
        return F.forall(F.filter(self.column(), lambda x: x.isNotNull()), lambda x: x)

    def any(self) -> Column:
        return F.exists(F.filter(self.column(), lambda x: x.isNotNull()), lambda x: x)

    def none(self) -> Column:
        return ~self.any()

    def num_valid(self) -> Column:
        return F.size(self.compress())

    # Reductions over the valid elements; null without any

    def sum(self) -> Column:
        zero = F.lit(0.0 if self.dtype.kind == "float" else 0).cast("double" if self.dtype.kind == "float" else "long")
        return F.when(self.num_valid() > 0, F.aggregate(self.compress(), zero, lambda s, x: s + x))

    def mean(self) -> Column:
        return self.sum() / self.num_valid()

    def min(self) -> Column:
        return F.array_min(self.compress())

    def max(self) -> Column:
        return F.array_max(self.compress())


def _range(n: int, p: slice) -> list[int]:
    start, end, _ = slice(p.start, p.stop).indices(n)
    kept = list(range(start, max(start, end)))
    step = 1 if p.step is None else p.step
    if not step:
        raise ShapeError("a step of 0")
    return kept[::step] if step > 0 else kept[::-1][::-step]


def _wider(a: DType, b: DType) -> DType:
    if a == b:
        return a
    if a.name not in _RANK or b.name not in _RANK:
        raise DataTypeError(f"{a} and {b} don't go together")
    wide = a if _RANK[a.name] >= _RANK[b.name] else b
    return float64 if wide.name == "float32" and "int" in (a.kind, b.kind) and max(_RANK[x.name] for x in (a, b) if x.kind == "int") > _RANK["uint16"] else wide


def _whole_division(x: Column, y: Column) -> Column:
    """Towards zero. By zero it is an error, as in the columns' own division."""
    return F.call_function("div", x, y)


def _division(x: Column, y: Column) -> Column:
    """As floats divide: by zero it is an infinity or NaN."""
    x, y = x.cast("double"), y.cast("double")
    inf = F.lit(float("inf"))
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).otherwise(F.when((x > 0) == (F.atan2(F.lit(0.0), y) == 0), inf).otherwise(-inf))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def _remainder(x: Column, y: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, F.lit(float("nan"))).otherwise(F.try_mod(x.cast("double"), y.cast("double")))


def _logarithm(x: Column, f) -> Column:
    """NaN below zero and -infinity at zero, where SQL has null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x), x.cast("double")).when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(f(x))


# Constructors


def literal(values, dtype: DType | None = None) -> Tensor:
    """A constant tensor from nested lists, a numpy array (masked ones too) or a number."""
    a = np.ma.asarray(values) if isinstance(values, np.ma.MaskedArray) else np.asarray(values)
    if dtype is None:
        dtype = string if a.dtype.kind in "UO" else bool_ if a.dtype.kind == "b" else int64 if a.dtype.kind in "iu" else float64
    gone = np.ma.getmaskarray(a).ravel() if isinstance(a, np.ma.MaskedArray) else [False] * a.size
    flat = [None if m or x is None else x for x, m in zip(np.ma.getdata(a).ravel().tolist(), gone)]
    array = F.array(*(F.lit(x).cast(dtype.spark) for x in flat)) if flat else F.array().cast(T.ArrayType(dtype.spark))
    return Tensor(array, a.shape, dtype)


def full(shape: Sequence[int], value, dtype: DType = float64) -> Tensor:
    return Tensor(F.array_repeat(F.lit(value).cast(dtype.spark), math.prod(shape)), shape, dtype)


def zeros(shape: Sequence[int], dtype: DType = float64) -> Tensor:
    return full(shape, 0, dtype)


def ones(shape: Sequence[int], dtype: DType = float64) -> Tensor:
    return full(shape, 1, dtype)


def linspace(start: float, end: float, n: int, dtype: DType = float64) -> Tensor:
    """n numbers from start, the end left out."""
    step = (end - start) / n if n else 0.0
    if not n:
        return literal([], dtype)
    return Tensor(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.lit(float(start)) + F.lit(step) * k).cast(dtype.spark)), (n,), dtype)


def arange(start, end, step=1, dtype: DType | None = None) -> Tensor:
    """start, and then on by steps while below the end."""
    n = max(1, math.ceil((end - start) / step))
    dtype = dtype or (int64 if all(isinstance(x, int) for x in (start, end, step)) else float64)
    return Tensor(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.lit(start) + F.lit(step) * k).cast(dtype.spark)), (n,), dtype)


def eye(n: int, dtype: DType = float64) -> Tensor:
    return Tensor(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.when(k % (n + 1) == 0, F.lit(1)).otherwise(F.lit(0)).cast(dtype.spark)), (n, n), dtype)


# Combine


def concat(axis: int, tensors: Sequence[Tensor]) -> Tensor:
    """Tensors one after another along an axis; the other axes must agree."""
    if not tensors:
        raise ShapeError("no tensors are given")
    axis = tensors[0]._axis(axis)
    rests = {t.shape[:axis] + t.shape[axis + 1 :] for t in tensors if t.rank == tensors[0].rank}
    if len(rests) > 1 or any(t.rank != tensors[0].rank for t in tensors):
        raise ShapeError(f"the shapes {', '.join(str(t.shape) for t in tensors)} can't be joined on axis {axis}")
    dtype = reduce(_wider, (t.dtype for t in tensors))
    starts = np.cumsum([0, *(t.size for t in tensors)])
    places = np.concatenate([(np.arange(t.size) + s).reshape(t.shape) for t, s in zip(tensors, starts)], axis)
    array = F.concat(*(t.column().cast(T.ArrayType(dtype.spark)) for t in tensors))
    return Tensor(array, places.shape, dtype, None if (np.diff(places.ravel()) == 1).all() else places)


def stack(axis: int, tensors: Sequence[Tensor]) -> Tensor:
    """Tensors of one shape along a new axis."""
    if not tensors:
        raise ShapeError("no tensors are given")
    if len({t.shape for t in tensors}) > 1:
        raise ShapeError("the shapes differ")
    return concat(axis % (tensors[0].rank + 1), [t.unsqueeze(axis) for t in tensors])
