"""Results on the driver: named columns, each a tensor whose axis 0 is the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from streamtable.errors import DataTypeError, ShapeError
from streamtable.types import SHAPE_KEY, DType, dtype_of


class FrameColumn:
    """A column's values with their type and shape."""

    def __init__(self, field: T.StructField, values: pa.ChunkedArray):
        self.field, self._values = field, values

    @property
    def name(self) -> str:
        return self.field.name

    @property
    def row_shape(self) -> tuple[int, ...] | None:
        if not isinstance(self.field.dataType, T.ArrayType):
            return None
        shape = self.field.metadata.get(SHAPE_KEY)
        return tuple(shape) if shape else (len(self._values[0]) if len(self._values) and self._values[0].is_valid else 0,)

    @property
    def shape(self) -> tuple[int, ...]:
        return (len(self._values), *(self.row_shape or ()))

    @property
    def nullable(self) -> bool:
        return self.field.nullable

    @property
    def dtype(self) -> DType:
        return dtype_of(self.field.dataType, self.field.metadata)

    def to_arrow(self) -> pa.ChunkedArray:
        return self._values

    def to_numpy(self) -> np.ndarray:
        """The values; masked where null, tensors with their shape."""
        shape, values = self.row_shape, self._values
        if shape is None:
            return _masked(values, (len(values),))
        if not values.null_count:
            return _masked(pa.chunked_array([c.flatten() for c in values.chunks], values.type.value_type), (len(values), *shape))
        n = int(np.prod(shape))
        return _masked(pa.chunked_array([pa.array([x for r in values.to_pylist() for x in (r if r is not None else [None] * n)], values.type.value_type)]), (len(values), *shape))


def _masked(values: pa.ChunkedArray, shape: tuple[int, ...]) -> np.ndarray:
    kind = values.type
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind):
        if not values.null_count:
            return values.to_numpy().reshape(shape)
        return np.ma.masked_array(values.fill_null(pa.scalar(0).cast(kind)).to_numpy().reshape(shape), values.is_null().to_numpy().reshape(shape))
    rows = values.to_pylist()
    if not values.null_count:
        return np.array(rows).reshape(shape)
    fill = next((v for v in rows if v is not None), 0)
    return np.ma.masked_array(np.array([fill if v is None else v for v in rows]).reshape(shape), np.array([v is None for v in rows]).reshape(shape))


class Frame:
    """A result table on the driver."""

    def __init__(self, table: pa.Table, schema: T.StructType):
        self._table, self.schema = table, schema

    @classmethod
    def of(cls, df: DataFrame) -> "Frame":
        return cls(df.toArrow(), df.schema)

    @classmethod
    def of_arrays(cls, **arrays) -> "Frame":
        """A frame from arrays by name, axis 0 being the rows; the first gives their number. Other axes make a tensor column."""
        n = len(next(iter(arrays.values())))
        fields, values = [], []
        for name, x in arrays.items():
            x = x if isinstance(x, np.ma.MaskedArray) else np.asarray(x)
            if len(x) != n:
                raise ShapeError(f"{name} has {len(x)} rows, the first column {n}")
            mask = np.ma.getmaskarray(x).ravel() if isinstance(x, np.ma.MaskedArray) else None
            flat = pa.array(np.ma.getdata(x).ravel(), mask=mask, from_pandas=False)
            kind = from_arrow_type(flat.type)
            if x.ndim > 1:
                width = int(np.prod(x.shape[1:]))
                flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, flat)
                fields.append(T.StructField(name, T.ArrayType(kind, True), True, {SHAPE_KEY: list(x.shape[1:])}))
            else:
                fields.append(T.StructField(name, kind, True))
            values.append(flat)
        return cls(pa.Table.from_arrays(values, names=list(arrays)), T.StructType(fields))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The frame as a DataFrame, with its shapes."""
        df = spark.createDataFrame(self._table)
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in self.schema.fields))

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def nrows(self) -> int:
        return self._table.num_rows

    @property
    def ncols(self) -> int:
        return len(self.schema.fields)

    def __len__(self) -> int:
        return self.nrows

    def icol(self, k: int) -> FrameColumn:
        return FrameColumn(self.schema.fields[k], self._table.column(k))

    def col(self, name: str, dtype: DType | None = None) -> FrameColumn:
        """A column by name; with dtype, an error if it has another type."""
        found = [k for k, n in enumerate(self.columns) if n == name]
        if len(found) != 1:
            raise KeyError(f"{len(found)} columns are called {name}")
        column = self.icol(found[0])
        if dtype is not None and column.dtype != dtype:
            raise DataTypeError(f"{name} is {column.dtype}, not {dtype}")
        return column

    __getitem__ = col

    def rows(self, cls=None):
        for r in zip(*(self.icol(k).to_numpy() for k in range(self.ncols))):
            yield tuple(r) if cls is None else cls(*r)

    def to_arrow(self) -> pa.Table:
        return self._table

    def arrow_schema(self) -> pa.Schema:
        return self._table.schema

    def to_pandas(self):
        return self._table.to_pandas()

    def pretty(self, most: int = 20) -> str:
        """The first rows as a table; long arrays are shortened, null is -."""

        def show(v, top: bool = True) -> str:
            if v is None:
                return "-"
            if isinstance(v, list):
                inner = [show(x, False) for x in v]
                return f"[{', '.join(inner if len(inner) <= 6 else [*inner[:3], '...', *inner[-3:]])}]"
            if isinstance(v, str):
                return f'"{v}"'
            return v.isoformat() if hasattr(v, "isoformat") else f"{v:g}" if isinstance(v, float) else str(v)

        body = [[show(v) for v in r.values()] for r in self._table.slice(0, most).to_pylist()] if len(set(self.columns)) == self.ncols else [[show(self._table.column(k)[i].as_py()) for k in range(self.ncols)] for i in range(min(most, self.nrows))]
        rows = [self.columns, *body]
        wide = [max(len(r[k]) for r in rows) for k in range(self.ncols)]
        line = lambda a, b, c: a + b.join("─" * (w + 2) for w in wide) + c
        text = lambda r: "│" + "│".join(f" {x:<{w}} " for x, w in zip(r, wide)) + "│"
        more = [f"... {self.nrows - most} more rows"] if self.nrows > most else []
        return "\n".join([line("┌", "┬", "┐"), text(rows[0]), line("├", "┼", "┤"), *map(text, rows[1:]), line("└", "┴", "┘"), *more])

    __str__ = pretty
