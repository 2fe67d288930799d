"""Column types: fourteen element types, fixed-shape tensor columns, and topic definitions."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtable.errors import DataTypeError, InvalidIndex

SHAPE_KEY = "tensor_shape"
LOGICAL_KEY = "logical"


@dataclass(frozen=True)
class DType:
    """An element type. Spark has no unsigned numbers: they are stored in the next larger signed type."""

    name: str
    spark: T.DataType = field(compare=False)
    numpy: str = field(compare=False)
    kind: str = field(compare=False)

    def __repr__(self) -> str:
        return self.name


bool_ = DType("bool", T.BooleanType(), "bool", "bool")
int8 = DType("int8", T.ByteType(), "int8", "int")
int16 = DType("int16", T.ShortType(), "int16", "int")
int32 = DType("int32", T.IntegerType(), "int32", "int")
int64 = DType("int64", T.LongType(), "int64", "int")
uint8 = DType("uint8", T.ShortType(), "uint8", "int")
uint16 = DType("uint16", T.IntegerType(), "uint16", "int")
uint32 = DType("uint32", T.LongType(), "uint32", "int")
uint64 = DType("uint64", T.DecimalType(20, 0), "uint64", "int")
float32 = DType("float32", T.FloatType(), "float32", "float")
float64 = DType("float64", T.DoubleType(), "float64", "float")
#: Nanoseconds in a long.
duration = DType("duration", T.LongType(), "int64", "int")
#: Microseconds in UTC: what a source has beyond that is lost.
timestamp = DType("timestamp", T.TimestampType(), "datetime64[us]", "time")
string = DType("string", T.StringType(), "object", "string")

DTYPES = {d.name: d for d in (bool_, int8, int16, int32, int64, uint8, uint16, uint32, uint64, float32, float64, duration, timestamp, string)}


def dtype_of(kind: T.DataType, metadata: dict | None = None) -> DType:
    """The element type of a Spark type; arrays give their elements'."""
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    named = (metadata or {}).get(LOGICAL_KEY)
    if named in DTYPES:
        return DTYPES[named]
    if isinstance(kind, T.TimestampNTZType):
        return timestamp
    for d in (bool_, int8, int16, int32, int64, float32, float64, timestamp, string, uint64):
        if d.spark == kind:
            return d
    raise DataTypeError(f"{kind.simpleString()} is not among the column types")


@dataclass(frozen=True)
class Column:
    """A column of a topic: a scalar, or with row_shape a tensor in each row, stored flattened in row-major order."""

    name: str
    dtype: DType
    row_shape: tuple[int, ...] | None = None
    required: bool = False

    @property
    def size(self) -> int:
        return math.prod(self.row_shape or ())

    def field(self) -> T.StructField:
        kind = self.dtype.spark if self.row_shape is None else T.ArrayType(self.dtype.spark, True)
        metadata: dict = {LOGICAL_KEY: self.dtype.name}
        if self.row_shape is not None:
            metadata[SHAPE_KEY] = list(self.row_shape)
        return T.StructField(self.name, kind, not self.required, metadata)

    def to_json(self) -> dict:
        return {"name": self.name, "dtype": self.dtype.name, "row_shape": self.row_shape and list(self.row_shape), "required": self.required}

    @classmethod
    def from_json(cls, x: dict) -> "Column":
        shape = x["row_shape"]
        return cls(x["name"], DTYPES[x["dtype"]], None if shape is None else tuple(shape), x["required"])


def column(name: str, dtype: DType | str, row_shape: tuple[int, ...] | int | None = None, required: bool = False) -> Column:
    if isinstance(dtype, str):
        if dtype not in DTYPES:
            raise DataTypeError(f"no type is called {dtype}")
        dtype = DTYPES[dtype]
    if isinstance(row_shape, int):
        row_shape = (row_shape,)
    return Column(name, dtype, None if row_shape is None else tuple(int(n) for n in row_shape), required)


@dataclass(frozen=True)
class TableConfig:
    """Sizes in rows."""

    write_batch_rows: int = 1024
    min_shard_rows: int = 1 << 20
    target_shard_rows: int = 1 << 25
    row_group_bytes: int = 128 << 20


@dataclass(frozen=True)
class Config:
    """How a datastore is opened: the names that come before unqualified ones, sizes of new topics, seconds between maintenance runs."""

    catalog: str = "main"
    schema: str = "public"
    table: TableConfig = TableConfig()
    maintenance_interval_s: float = 30.0


@dataclass(frozen=True)
class TopicInfo:
    """A topic's fixed schema, declared order and sizes."""

    columns: tuple[Column, ...]
    time_column: str = "time"
    indices: tuple[tuple[str, bool], ...] = ()
    temporary: bool = False
    config: TableConfig = TableConfig()

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def order(self):
        """The declared order as sort columns, nulls first."""
        return [F.col(f"`{n}`").asc_nulls_first() if up else F.col(f"`{n}`").desc_nulls_first() for n, up in self.indices]

    def conform(self, df: DataFrame) -> DataFrame:
        """df with exactly these columns in this order, cast, with required values and tensor sizes checked as rows are written."""
        have = {c.lower(): c for c in df.columns}
        unknown = [c for c in df.columns if c.lower() not in {x.name.lower() for x in self.columns}]
        if unknown:
            raise DataTypeError(f"the table has no column {', '.join(unknown)}")
        out = []
        for c in self.columns:
            kind = c.field().dataType
            found = have.get(c.name.lower())
            if found is None and c.required:
                raise DataTypeError(f"column {c.name} is required")
            value = F.lit(None).cast(kind) if found is None else F.col(f"`{found}`").cast(kind)
            if c.row_shape is not None:
                value = F.when(value.isNull() | (F.size(value) == c.size), value).otherwise(F.raise_error(F.lit(f"{c.name} must have {c.size} elements")).cast(kind))
            if c.required:
                value = F.coalesce(value, F.raise_error(F.lit(f"{c.name} must not be null")).cast(kind))
            out.append(value.alias(c.name, metadata=c.field().metadata))
        return df.select(out)

    def to_json(self) -> dict:
        return {
            "columns": [c.to_json() for c in self.columns], "time_column": self.time_column, "indices": [list(x) for x in self.indices],
            "temporary": self.temporary, "config": self.config.__dict__,
        }

    @classmethod
    def from_json(cls, x: dict) -> "TopicInfo":
        return cls(tuple(map(Column.from_json, x["columns"])), x["time_column"], tuple((n, up) for n, up in x["indices"]), x["temporary"], TableConfig(**x["config"]))


def topic(*columns: Column, time_column: str = "time", index: tuple = (), temporary: bool = False, config: TableConfig | None = None) -> TopicInfo:
    """A topic's definition. A required timestamp column comes first, ascending; index adds (name, ascending) pairs or names."""
    if any(c.name == time_column for c in columns):
        raise DataTypeError(f"{time_column} is the time column's name")
    own = (Column(time_column, timestamp, None, True), *columns)
    names = [c.name for c in own]
    if len({n.lower() for n in names}) < len(names):
        raise DataTypeError("two columns have one name")
    indices = [(time_column, True), *((x, True) if isinstance(x, str) else (x[0], bool(x[1])) for x in index)]
    for name, _ in indices:
        if name not in names:
            raise InvalidIndex(f"no column is called {name}")
    return TopicInfo(own, time_column, tuple(indices), temporary, config or TableConfig())


def from_schema(schema: T.StructType, time_column: str) -> TopicInfo:
    """A topic for a DataFrame's schema, whose own time column is named."""
    rest = []
    for f in schema.fields:
        if f.name == time_column:
            continue
        shape = f.metadata.get(SHAPE_KEY)
        if isinstance(f.dataType, T.ArrayType) and shape is None:
            raise DataTypeError(f"{f.name} needs a shape in its metadata")
        rest.append(Column(f.name, dtype_of(f.dataType, f.metadata), None if shape is None else tuple(shape), not f.nullable))
    info = topic(*rest, time_column=time_column)
    order = {f.name: k for k, f in enumerate(schema.fields)}
    return replace(info, columns=tuple(sorted(info.columns, key=lambda c: order[c.name])))


def spark_value(c: Column, value):
    """A Python or numpy value as Spark takes it for a column."""
    if value is None:
        return None
    if c.row_shape is None:
        value = value.item() if isinstance(value, np.generic) else value
        if c.dtype is duration and hasattr(value, "total_seconds"):
            return round(value.total_seconds() * 1e9)
        return float(value) if c.dtype.kind == "float" else value
    flat = np.asarray(value)
    if flat.shape != c.row_shape:
        raise DataTypeError(f"{c.name} has rows of shape {c.row_shape}, not {flat.shape}")
    flat = flat.astype(float) if c.dtype.kind == "float" else flat
    if isinstance(value, np.ma.MaskedArray):
        return [None if m else x for x, m in zip(flat.ravel().tolist(), np.ma.getmaskarray(value).ravel().tolist())]
    return flat.ravel().tolist()


def dumps(x) -> str:
    return json.dumps(x, sort_keys=True)
