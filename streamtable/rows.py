"""Typed rows: publishing them one by one or in arrays, and reading them back."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING, Annotated, get_args, get_origin, get_type_hints

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from streamtable.errors import DataTypeError
from streamtable.types import SHAPE_KEY, Column, DType, bool_, column, float64, int64, spark_value, string, timestamp

if TYPE_CHECKING:
    from streamtable.sources.topic import Topic


def now() -> dt.datetime:
    """This moment in UTC."""
    return dt.datetime.now(dt.timezone.utc)


def row(*values) -> tuple:
    """A row with this moment as its time."""
    return (now(), *values)


_PLAIN = {bool: bool_, int: int64, float: float64, str: string, dt.datetime: timestamp}


def columns_of(cls) -> list[Column]:
    """Columns of a dataclass. A field is a Python type, or Annotated[type, DType] or Annotated[type, DType, shape]; Optional ones are nullable."""
    hints = get_type_hints(cls, include_extras=True)
    out = []
    for f in dataclasses.fields(cls):
        hint, dtype, shape = hints[f.name], None, None
        if get_origin(hint) is Annotated:
            hint, *extra = get_args(hint)
            for x in extra:
                if isinstance(x, DType):
                    dtype = x
                elif isinstance(x, tuple):
                    shape = x
        options = get_args(hint)
        nullable = type(None) in options
        if nullable:
            hint = next(x for x in options if x is not type(None))
        dtype = dtype or _PLAIN.get(hint)
        if dtype is None:
            raise DataTypeError(f"{f.name}: no column type for {hint}")
        out.append(column(f.metadata.get("name", f.name), dtype, shape, not nullable))
    return out


def flatten(value) -> list:
    """The column values of composable rows: tuples, lists and dataclasses span as many columns as their parts; arrays are one."""
    if dataclasses.is_dataclass(value):
        return [x for f in dataclasses.fields(value) for x in flatten(getattr(value, f.name))]
    if isinstance(value, (tuple, list)):
        return [x for v in value for x in flatten(v)]
    return [value]


class Publisher:
    """Buffers rows on the driver and appends them as a shard when `buffer_rows` are there, on flush and on close.

    Reads of the topic in this process see what is buffered.
    """

    def __init__(self, topic: "Topic", buffer_rows: int):
        self.topic, self.buffer_rows = topic, buffer_rows
        self._rows: list[tuple] = []
        self._tables: list[pa.Table] = []
        self._closed = False
        self._open = topic.registry.publishers.setdefault(topic.id, [])
        self._open.append(self)

    def __enter__(self) -> "Publisher":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
        elif self in self._open:  # what is held is given up
            self._closed = True
            self._open.remove(self)

    def _complete(self, values: tuple, named: dict, stamp) -> list:
        """Values in the order of the columns, with the time put first if it is left out."""
        columns = self.topic.info.columns
        if values and named:
            raise TypeError("give values by place or by name, not both")
        if named:
            unknown = set(named) - {c.name for c in columns}
            if unknown:
                raise DataTypeError(f"the table has no column {', '.join(sorted(unknown))}")
            time_name = self.topic.info.time_column
            return [named[c.name] if c.name in named else stamp() if c.name == time_name else None for c in columns]
        out = list(values)
        if len(out) == len(columns) - 1:
            out.insert(0, stamp())
        if len(out) != len(columns):
            raise DataTypeError(f"{len(out)} values for {len(columns)} columns")
        return out

    def write(self, *values, **named) -> None:
        """Add one row, by place or by name."""
        if self._closed:
            raise ValueError("the publisher is closed")
        flat = [x for v in values for x in flatten(v)]
        done = self._complete(tuple(flat), named, now)
        for c, v in zip(self.topic.info.columns, done):
            if v is None and c.required:
                raise DataTypeError(f"column {c.name} is required")
        self._rows.append(tuple(spark_value(c, v) for c, v in zip(self.topic.info.columns, done)))
        if len(self) >= self.buffer_rows:
            self.flush()

    def write_batch(self, *arrays, **named) -> None:
        """Add rows from arrays, axis 0 being the rows; they are put in the order of the columns."""
        first = arrays[0] if arrays else next(iter(named.values()))
        n = len(first)
        done = self._complete(arrays, named, lambda: [now()] * n)
        if any(x is not None and len(x) != n for x in done):
            raise DataTypeError("the arrays have different lengths")
        if self._closed:
            raise ValueError("the publisher is closed")
        columns = self.topic.info.columns
        schema = to_arrow_schema(self.topic.schema)
        arrays = [_arrow(c, x, n, f.type) for c, x, f in zip(columns, done, schema)]
        for c, x in zip(columns, arrays):
            if x.null_count and c.required:
                raise DataTypeError(f"column {c.name} is required")
        self._tables.append(pa.Table.from_arrays(arrays, names=[c.name for c in columns]))
        if len(self) >= self.buffer_rows:
            self.flush()

    def __len__(self) -> int:
        """The number of rows that are held."""
        return len(self._rows) + sum(t.num_rows for t in self._tables)

    def held(self) -> DataFrame | None:
        """The rows that aren't appended yet."""
        session, schema = self.topic.session, self.topic.schema
        parts = [session.createDataFrame(list(self._rows), schema)] if self._rows else []
        if self._tables:
            parts.append(session.createDataFrame(pa.concat_tables(self._tables)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def flush(self) -> int:
        df = self.held()
        if df is None:
            return 0
        rows, tables, self._rows, self._tables = self._rows, self._tables, [], []
        try:
            return self.topic.append(df)
        except BaseException:
            self._rows, self._tables = rows + self._rows, tables + self._tables
            raise

    def close(self) -> None:
        if not self._closed:
            self.flush()
            self._closed = True
            if self in self._open:
                self._open.remove(self)


def _arrow(c: Column, values, n: int, kind: pa.DataType) -> pa.Array:
    """A column's values, axis 0 being the rows, as Arrow has them: numpy's buffers where they can be taken over."""
    if values is None:
        return pa.nulls(n, kind)
    x = values if isinstance(values, np.ndarray) else None
    if c.row_shape is not None and x is None and all(v is not None for v in values):
        x = np.ma.stack(values) if any(isinstance(v, np.ma.MaskedArray) for v in values) else np.asarray(values)
    if x is None or x.dtype.kind not in "iufb":
        return pa.array([spark_value(c, v) for v in values], kind)
    mask = np.ma.getmaskarray(x).ravel() if isinstance(x, np.ma.MaskedArray) else None
    flat = pa.array(np.ascontiguousarray(np.ma.getdata(x)).ravel(), mask=mask)
    if c.row_shape is None:
        return flat.cast(kind)
    if x.shape[1:] != c.row_shape:
        raise DataTypeError(f"{c.name} has rows of shape {c.row_shape}, not {x.shape[1:]}")
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * c.size, flat.cast(kind.value_type))


def read_rows(df: DataFrame, cls=None) -> Iterator:
    """Rows of a DataFrame one after another: tuples, or objects of a dataclass; tensors as numpy arrays."""
    shapes = {f.name: f.metadata.get(SHAPE_KEY) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    for r in df.toLocalIterator(prefetchPartitions=True):
        values = [_tensor(v, shapes[c]) if c in shapes and v is not None else v for c, v in zip(df.columns, r)]
        yield tuple(values) if cls is None else cls(*values[-len(dataclasses.fields(cls)) :])


def _tensor(values: list, shape: list[int] | None) -> np.ndarray:
    if any(v is None for v in values):
        fill = next((v for v in values if v is not None), 0)
        return np.ma.masked_array(np.array([fill if v is None else v for v in values]), [v is None for v in values]).reshape(shape or -1)
    return np.array(values).reshape(shape or -1)
