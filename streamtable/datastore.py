"""Opening a datastore, its tables, and SQL over them."""

from __future__ import annotations

import dataclasses
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from streamtable.errors import ConcurrentChange, DataTypeError, ShapeError, StreamtableError, TableKindError, TableNotFound
from streamtable.frame import Frame
from streamtable.functions import scalar
from streamtable.plans import dialect, statements
from streamtable.plans.registry import DEFAULT_CATALOG, DEFAULT_SCHEMA, Registry, new_id
from streamtable.sources.store import Store
from streamtable.sources.topic import Topic, View
from streamtable.types import SHAPE_KEY, Config, DType, TableConfig, TopicInfo, dtype_of


def open(spark: SparkSession, root: str, create: bool = False, config: Config | None = None) -> "Datastore":  # noqa: A001
    """Open the datastore at a path or URL; with create, make it if there is none. Config names catalogs and schemas that are there."""
    store = Store(spark, root)
    if not store.exists(store.path("datastore.json")):
        if not create:
            raise StreamtableError(f"there is no datastore at {root}")
        store.write_json(store.path("datastore.json"), {"format": 1})
    config = config or Config()
    ds = Datastore(spark, store, config=config)
    if config.catalog != ds.catalog:
        ds = ds.use_catalog(config.catalog)
    return ds.use_schema(config.schema) if config.schema != ds.schema else ds


class Query:
    """A lazy query: a DataFrame with the reading methods of this library."""

    def __init__(self, datastore: "Datastore", df: DataFrame, sql: str | None = None):
        self.datastore, self.df, self._sql = datastore, df, sql

    def limit(self, n: int) -> "Query":
        return Query(self.datastore, self.df.limit(n))

    def skip(self, n: int) -> "Query":
        return Query(self.datastore, self.df.offset(n))

    def col(self, name: str) -> "Query":
        """One column. A name that several columns have is an error."""
        return Query(self.datastore, self.df.select(name if "." in name else f"`{name}`"))

    def typed(self, name: str, dtype: DType | None = None, axes: int | None = None) -> "Query":
        """One column, of a type and with a number of axes, the rows being the first; an error if it has others."""
        one = self.col(name)
        field = one.df.schema.fields[0]
        if dtype is not None and dtype_of(field.dataType, field.metadata) != dtype:
            raise DataTypeError(f"{name} is {dtype_of(field.dataType, field.metadata)}, not {dtype}")
        have = 1 + (len(field.metadata.get(SHAPE_KEY) or [0]) if isinstance(field.dataType, T.ArrayType) else 0)
        if axes is not None and have != axes:
            raise ShapeError(f"{name} has {have} axes, not {axes}")
        return one

    def col1(self, name: str, dtype: DType | None = None) -> "Query":
        return self.typed(name, dtype, 1)

    def col2(self, name: str, dtype: DType | None = None) -> "Query":
        return self.typed(name, dtype, 2)

    def col3(self, name: str, dtype: DType | None = None) -> "Query":
        return self.typed(name, dtype, 3)

    def col_dyn(self, name: str, dtype: DType | None = None) -> "Query":
        return self.typed(name, dtype)

    def execute(self) -> Frame:
        """The whole result on the driver."""
        return Frame.of(self.df)

    def stream(self, batch_rows: int = 1024) -> Iterator[pa.RecordBatch]:
        """Result batches; a partition at a time is on the driver."""

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, batch_rows):
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, batch.schema) as writer:
                        writer.write_batch(batch.slice(k, batch_rows))
                    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])

        for row in self.df.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
            yield from pa.ipc.open_stream(bytes(row[0]))

    def __iter__(self) -> Iterator[Frame]:
        for batch in self.stream():
            yield Frame(pa.Table.from_batches([batch]), self.df.schema)

    def rows(self, cls=None) -> Iterator:
        from streamtable.rows import read_rows

        return read_rows(self.df, cls)

    def create_view(self, name: str, **options) -> View:
        if self._sql is None:
            raise StreamtableError("only a query as it was given as SQL can be stored as a view")
        return self.datastore.create_view(name, self._sql, **options)


class Tables:
    """Tables by name."""

    def __init__(self, datastore: "Datastore"):
        self._ds = datastore

    def get(self, name: str) -> Topic | View | None:
        try:
            return self[name]
        except TableNotFound:
            return None

    def __getitem__(self, name: str) -> Topic | View:
        return self._ds.table(name)

    def get_or_create(self, name: str, info: TopicInfo) -> Topic:
        return self._ds.create_topic(name, info, if_not_exists=True)

    def create(self, name: str, info: TopicInfo) -> Topic:
        """Create a topic in place of whatever had the name."""
        return self._ds.create_topic(name, info, or_replace=True)

    def drop(self, name: str, if_exists: bool = False) -> None:
        full = self._ds.resolve(name)
        kind = self._ds.registry.table(full)["kind"] if self._ds.registry.has(full) else "topic"
        self._ds.drop(name, kind, if_exists)

    def names(self) -> list[str]:
        self._ds.registry.refresh()
        return sorted(self._ds.registry.schema(self._ds.catalog, self._ds.schema))


class Datastore:
    """A handle with its own default catalog and schema."""

    def __init__(self, spark: SparkSession, store: Store, catalog: str = DEFAULT_CATALOG, schema: str = DEFAULT_SCHEMA, registry: Registry | None = None, config: Config | None = None):
        self.spark = spark
        self.config = config or Config()
        self._maintenance: tuple[threading.Thread, threading.Event] | None = None
        # Views are bound here, out of the way of the caller's own.
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.session.timeZone", "UTC")
        scalar.register(self.session)
        self.registry = registry or Registry(store)
        self.catalog, self.schema = catalog, schema
        if registry is None:
            self.registry.create_catalog(DEFAULT_CATALOG, if_not_exists=True)
        self.tables = Tables(self)

    def __enter__(self) -> "Datastore":
        return self

    def __exit__(self, *_) -> None:
        self.shutdown()

    def shutdown(self) -> None:
        """End maintenance and write a snapshot of the registry. Everything published is durable without it."""
        self.stop_maintenance()
        self.registry.snapshot()

    # Names

    def use_catalog(self, catalog: str) -> "Datastore":
        """A handle with another default catalog."""
        self.registry.refresh()
        self.registry.schema(catalog, DEFAULT_SCHEMA)
        return Datastore(self.spark, self.registry.store, catalog, DEFAULT_SCHEMA, self.registry, self.config)

    def use_schema(self, schema: str) -> "Datastore":
        self.registry.refresh()
        self.registry.schema(self.catalog, schema)
        return Datastore(self.spark, self.registry.store, self.catalog, schema, self.registry, self.config)

    def resolve(self, name: str | tuple[str, ...]) -> tuple[str, str, str]:
        """A name of one to three parts with the defaults before it."""
        parts = tuple(name.split(".")) if isinstance(name, str) else tuple(name)
        if not 1 <= len(parts) <= 3 or not all(parts):
            raise StreamtableError(f"{name!r} is not a table's name")
        return (*(self.catalog, self.schema)[: 3 - len(parts)], *parts)

    # Tables

    def table(self, name: str) -> Topic | View:
        self.registry.refresh()
        return self._table(self.resolve(name))

    def _table(self, full: tuple[str, str, str]) -> Topic | View:
        t = self.registry.table(full)
        return Topic(self.session, self.registry, full, t) if t["kind"] == "topic" else View(self, full, t)

    def create_topic(self, name: str, info: TopicInfo, if_not_exists: bool = False, or_replace: bool = False) -> Topic:
        full = self.resolve(name)
        if info.config == TableConfig():
            info = dataclasses.replace(info, config=self.config.table)
        _, old = self.registry.create_table(full, {"kind": "topic", "topic": info.to_json(), "shards": []}, if_not_exists, or_replace)
        self._clear(old)
        return self._table(full)

    def create_view(self, name: str, query: str, if_not_exists: bool = False, or_replace: bool = False, materialize: bool = False, index=()) -> View:
        if index and not materialize:
            raise StreamtableError("only a materialized view can have an index")
        self._plan(query, self.catalog, self.schema)  # an invalid query is an error now
        full = self.resolve(name)
        indices = [[x, True] if isinstance(x, str) else [x[0], bool(x[1])] for x in index]
        definition = {"kind": "view", "query": query, "catalog": self.catalog, "schema": self.schema, "materialized": materialize, "indices": indices}
        if materialize and not (if_not_exists and self.registry.has(full)):
            # Its rows are there before its name is.
            definition["id"] = new_id()
            View(self, full, definition).refresh()
        try:
            new, old = self.registry.create_table(full, definition, if_not_exists, or_replace)
        except Exception:
            self._clear(definition if "id" in definition else None)
            raise
        if new["id"] != definition.get("id", new["id"]):  # another was first
            self._clear(definition)
        self._clear(old)
        return self._table(full)

    def drop(self, name: str, kind: str, if_exists: bool = False) -> None:
        self._clear(self.registry.drop_table(self.resolve(name), kind, if_exists))

    def _clear(self, table: dict | None) -> None:
        if table is not None:
            self.registry.store.delete(self.registry.store.path("data", table["id"]))

    def create_catalog(self, name: str, if_not_exists: bool = False) -> None:
        self.registry.create_catalog(name, if_not_exists)

    def drop_catalog(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        for t in self.registry.drop_catalog(name, if_exists, cascade):
            self._clear(t)

    def create_schema(self, name: str, if_not_exists: bool = False) -> None:
        *catalog, schema = name.split(".")
        self.registry.create_schema(catalog[0] if catalog else self.catalog, schema, if_not_exists)

    def drop_schema(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        *catalog, schema = name.split(".")
        for t in self.registry.drop_schema(catalog[0] if catalog else self.catalog, schema, if_exists, cascade):
            self._clear(t)

    # SQL

    def query(self, sql: str) -> Query:
        df = self.sql(sql)
        return Query(self, df, sql if statements.is_query(sql) else None)

    def execute(self, sql: str) -> Frame:
        return self.query(sql).execute()

    def sql(self, sql: str) -> DataFrame:
        """Run a statement: queries go to Spark, names and definitions are handled here."""
        self.registry.refresh()
        return statements.run(self, sql)

    def _plan(self, sql: str, catalog: str, schema: str, _open: tuple = ()) -> DataFrame:
        """Bind the tables that a query names to views of the session, and plan it."""
        for full, bound in statements.tables_in(self.registry, sql, catalog, schema):
            if full[1] == "information_schema":
                self.information_schema(full[0], full[2]).createOrReplaceTempView(bound)
                continue
            if full in _open:
                raise StreamtableError(f"view {'.'.join(full)} is defined by itself")
            table = self._table(full)
            if table.kind == "view" and not table.materialized:
                df = self._plan(table.query, table._catalog, table._schema, (*_open, full))
            else:
                df = table.read()
            df.createOrReplaceTempView(bound)
        return self.session.sql(dialect.rewrite(statements.bound(self.registry, sql, catalog, schema)))

    def information_schema(self, catalog: str, name: str) -> DataFrame:
        """Tables, columns, views, schemata and df_settings of a catalog."""
        schemas = self.registry.catalogs[catalog]
        found = [(catalog, s, n, t) for s, tables in sorted(schemas.items()) for n, t in sorted(tables.items())]
        make = self.session.createDataFrame
        if name == "schemata":
            return make([(catalog, s) for s in sorted(schemas)], "catalog_name string, schema_name string")
        if name == "tables":
            kinds = {"topic": "BASE TABLE", "view": "VIEW"}
            return make([(c, s, n, kinds[t["kind"]]) for c, s, n, t in found], "table_catalog string, table_schema string, table_name string, table_type string")
        if name == "views":
            return make([(c, s, n, t.get("query")) for c, s, n, t in found if t["kind"] == "view"], "table_catalog string, table_schema string, table_name string, definition string")
        if name == "df_settings":
            return make([(k, v) for k, v in sorted({"catalog": self.catalog, "schema": self.schema}.items())], "name string, value string")
        if name == "columns":
            rows = []
            for c, s, n, _ in found:
                for k, f in enumerate(self._table((c, s, n)).schema.fields):
                    rows.append((c, s, n, f.name, k, "YES" if f.nullable else "NO", f.dataType.simpleString()))
            return make(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
        raise TableNotFound(f"{catalog}.information_schema.{name}")

    def describe(self, name: str) -> DataFrame:
        table = self.table(name)
        rows = []
        for f in table.schema.fields:
            kind = dtype_of(f.dataType, f.metadata).name if not isinstance(f.dataType, (T.StructType, T.MapType, T.DecimalType, T.DateType)) else f.dataType.simpleString()
            rows.append((f.name, kind, str(f.metadata.get("tensor_shape") or ""), f.nullable))
        return self.session.createDataFrame(rows, "column_name string, data_type string, row_shape string, nullable boolean")

    def insert(self, name: str, df: DataFrame) -> int:
        table = self.table(name)
        if table.kind != "topic":
            raise TableKindError(f"{name} is a view")
        return table.append(df)

    # Maintenance

    def start_maintenance(self, interval_s: float | None = None, older_than_s: float = 7 * 86400) -> None:
        """Run maintain() again and again on a thread of the driver, until shutdown. One process of a datastore should do so."""
        if self._maintenance is not None:
            return
        done = threading.Event()
        pause = self.config.maintenance_interval_s if interval_s is None else interval_s

        def run() -> None:
            while not done.wait(pause):
                try:
                    self.maintain(older_than_s)
                except ConcurrentChange:  # others were at it; the next run looks again
                    continue
                except Exception as e:
                    self.maintenance_error = e

        self.maintenance_error: Exception | None = None
        thread = threading.Thread(target=run, name="streamtable-maintenance", daemon=True)
        self._maintenance = thread, done
        thread.start()

    def stop_maintenance(self) -> None:
        if self._maintenance is not None:
            thread, done = self._maintenance
            self._maintenance = None
            done.set()
            thread.join()

    def metrics(self) -> DataFrame:
        """A row for each topic: its shards, committed rows, and the rows and capacity of its open publishers' buffers."""
        self.registry.refresh()
        rows = []
        for catalog, schemas in sorted(self.registry.catalogs.items()):
            for schema, tables in sorted(schemas.items()):
                for name, t in sorted(tables.items()):
                    if t["kind"] == "topic":
                        own = self.registry.publishers.get(t["id"], ())
                        rows.append((catalog, schema, name, len(t["shards"]), sum(s["rows"] for s in t["shards"]), sum(map(len, own)), sum(p.buffer_rows for p in own)))
        return self.session.createDataFrame(rows, "catalog string, schema string, topic string, shards int, rows long, held long, capacity long")

    def maintain(self, older_than_s: float = 7 * 86400) -> None:
        """Compact and vacuum every topic, and delete the data of tables that are gone. For a scheduled job."""
        self.registry.refresh()
        known = set()
        for catalog, schemas in self.registry.catalogs.items():
            for schema, tables in schemas.items():
                for name, t in list(tables.items()):
                    known.add(t["id"])
                    if t["kind"] == "topic":
                        topic = self._table((catalog, schema, name))
                        topic.compact()
                        topic.vacuum(older_than_s)
        store = self.registry.store
        for name in store.names(store.path("data")):
            if name not in known and store.age_ms(store.path("data", name)) >= older_than_s * 1000:
                store.delete(store.path("data", name))
        self.registry.snapshot()
