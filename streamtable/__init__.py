"""Time-series tables, views and tensor columns on Spark."""

from streamtable import errors, types
from streamtable.datastore import Datastore, Query, open
from streamtable.frame import Frame
from streamtable.rows import Publisher, columns_of, now, row
from streamtable.types import (
    Config,
    TableConfig,
    bool_,
    column,
    duration,
    float32,
    float64,
    int8,
    int16,
    int32,
    int64,
    string,
    timestamp,
    topic,
    uint8,
    uint16,
    uint32,
    uint64,
)

__all__ = [
    "Config", "Datastore", "Frame", "Publisher", "Query", "TableConfig", "bool_", "column", "columns_of", "duration", "errors", "float32", "float64", "int16", "int32",
    "int64", "int8", "now", "open", "row", "string", "timestamp", "topic", "types", "uint16", "uint32", "uint64", "uint8",
]
