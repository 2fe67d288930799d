"""Registered queries of what the engine does beside SQL: publishing, typed rows, frames, statements, handles and streams.

Each works in a datastore of its own, does what it is named for, and returns rows that SQL can give from the plain tables. Rows
that are published one by one come from the nation and region tables, which have 25 and 5 rows at every scale.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Annotated

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import streamtable as st
from streamtable import errors
from streamtable.operators import tensor as tn
from streamtable.queries import _EVENTS, _datastore, _events, _filled, _query, table
from streamtable.streaming import live

_NATION = st.topic(st.column("k", st.int64), st.column("name", st.string))
_AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()


@_query("publish_rows", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def publish_rows(spark, sf_dir):
    """Row by row, by place and by name, and in arrays; half of it is flushed and half still held when it is read."""
    ds = _datastore(spark)
    t = ds.create_topic("n", _NATION)
    rows = _nations(spark, sf_dir)
    pb = t.publish()
    for r in rows[:5]:
        pb.write(r.n_nationkey, r.n_name)
        pb.flush()
    for r in rows[5:10]:
        pb.write(time=_AT, name=r.n_name, k=r.n_nationkey)
    pb.write_batch(k=np.array([r.n_nationkey for r in rows[10:]]), name=[r.n_name for r in rows[10:]])
    return ds.sql("SELECT k, name FROM n")


@dataclass
class _Place:
    region: int
    corners: Annotated[np.ndarray, st.float32, (2,)]


@dataclass
class _Nation:
    k: int
    name: str
    at: Annotated[float, st.float64]


@_query("rows_typed", "SELECT n_nationkey::BIGINT AS k, n_name AS name, n_regionkey + 0.5 AS at FROM nation")
def rows_typed(spark, sf_dir):
    """Dataclass rows out and in."""
    ds = _datastore(spark)
    t = ds.create_topic("n", st.topic(*st.columns_of(_Nation)))
    with t.publish() as pb:
        for r in _nations(spark, sf_dir):
            pb.write(_Nation(r.n_nationkey, r.n_name, r.n_regionkey + 0.5))
    back = list(ds.query("SELECT * FROM n").rows(_Nation))
    return spark.createDataFrame([(x.k, x.name, x.at) for x in back], "k long, name string, at double")


@_query("rows_composed", "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS region, n_nationkey + 1.0 AS second FROM nation")
def rows_composed(spark, sf_dir):
    """Tuples of scalars and dataclasses with tensors span as many columns as their parts."""
    ds = _datastore(spark)
    t = ds.create_topic("n", st.topic(st.column("k", st.int64), *st.columns_of(_Place)))
    with t.publish() as pb:
        for r in _nations(spark, sf_dir):
            pb.write(*st.row(r.n_nationkey, _Place(r.n_regionkey, np.array([0.0, r.n_nationkey + 1.0]))))
    back = [(r[1], r[2], float(r[3][1])) for r in ds.query("SELECT * FROM n").rows()]
    return spark.createDataFrame(back, "k long, region long, second double")


@_query("lazy_columns", "SELECT n_nationkey::BIGINT AS k FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 3")
def lazy_columns(spark, sf_dir):
    """A lazy query's column of a type, skipped and limited, as a stream of batches."""
    ds = _datastore(spark)
    ds.create_topic("n", _NATION).append(table(spark, sf_dir, "nation").select(F.lit(_AT).alias("time"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    q = ds.query("SELECT * FROM n ORDER BY k").col1("k", st.int64).skip(3).limit(7)
    return spark.createDataFrame([(k,) for batch in q.stream(2) for k in batch.column(0).to_pylist()], "k long")


@_query("lazy_ambiguous", "SELECT true AS refused")
def lazy_ambiguous(spark, sf_dir):
    """A name that two columns have is an error, not either of them."""
    try:
        _datastore(spark).query("SELECT 1 AS a, 2 AS a").col("a").execute()
    except Exception as e:
        return spark.createDataFrame([("AMBIGUOUS" in str(e),)], "refused boolean")
    return spark.createDataFrame([(False,)], "refused boolean")


@_query("frame_roundtrip", "SELECT n_nationkey::BIGINT AS k, n_regionkey * 2.0 + n_nationkey AS total FROM nation")
def frame_roundtrip(spark, sf_dir):
    """A frame of arrays to a DataFrame and a frame back: columns, shapes, rows."""
    rows = _nations(spark, sf_dir)
    x = np.array([[[r.n_regionkey, 0.0], [r.n_regionkey, r.n_nationkey]] for r in rows])
    back = st.Frame.of(st.Frame.of_arrays(k=np.array([r.n_nationkey for r in rows]), x=x).to_df(spark))
    assert (back.nrows, back.ncols, back["x"].shape, back.icol(0).name) == (len(rows), 2, (len(rows), 2, 2), "k")
    return spark.createDataFrame([(int(k), float(v.sum())) for k, v in back.rows()], "k long, total double")


@_query("topic_create_table_as", "SELECT epoch_us(ts) AS t, value * 2 AS v FROM events WHERE event_type = 'click'")
def topic_create_table_as(spark, sf_dir):
    ds, _ = _filled(spark, sf_dir)
    ds.sql("CREATE TABLE doubled AS SELECT time, value * 2 AS v FROM events WHERE event_type = 'click'")
    return ds.sql("SELECT unix_micros(time) AS t, v FROM doubled")


@_query("topic_create_and_insert", "SELECT epoch_us(ts) AS t, event_id AS id FROM events WHERE value > 90")
def topic_create_and_insert(spark, sf_dir):
    """CREATE TABLE with columns, INSERT with names in another order, by qualified names, at a root given as a URL."""
    ds, _ = _filled(spark, sf_dir)
    ds = st.open(spark, ds.registry.store.root if "://" in ds.registry.store.root else ds.registry.store.root.replace("file:", "file://", 1))
    ds.sql("CREATE CATALOG other")
    ds.sql("CREATE TABLE other.public.high (at TIMESTAMP NOT NULL, id BIGINT)")
    ds.sql("INSERT INTO other.public.high (id, at) SELECT event_id, time FROM main.public.events WHERE value > 90")
    return ds.use_catalog("other").sql("SELECT unix_micros(at) AS t, id FROM high")


@_query("topic_drops", "SELECT * FROM (VALUES ('main', 'public', 'events'), ('main', 'public', 'kept')) t(table_catalog, table_schema, table_name)")
def topic_drops(spark, sf_dir):
    """Tables, views, schemas and catalogs made and dropped; what is there in the end."""
    ds = _datastore(spark)
    ds.create_topic("events", _EVENTS)
    for sql in (
        "CREATE VIEW kept AS SELECT * FROM events", "CREATE VIEW gone AS SELECT * FROM kept", "CREATE SCHEMA s", "CREATE VIEW s.v AS SELECT 1 AS one", "CREATE CATALOG c",
        "CREATE SCHEMA c.s", "CREATE VIEW c.s.v AS SELECT 2 AS two", "CREATE TABLE t (at TIMESTAMP)", "DROP VIEW gone", "DROP TABLE t", "DROP TABLE IF EXISTS t",
        "DROP SCHEMA s CASCADE", "DROP CATALOG c CASCADE", "CREATE OR REPLACE VIEW kept AS SELECT event_id FROM events",
    ):
        ds.sql(sql)
    return ds.sql("SELECT table_catalog, table_schema, table_name FROM information_schema.tables")


@_query("statement_errors", "SELECT * FROM (VALUES ('TableExists'), ('TableNotFound'), ('SchemaNotEmpty'), ('SchemaNotFound'), ('CatalogNotFound'), ('TableKindError'), ('TableKindError'), ('TableKindError'), ('TableKindError')) t(error)")
def statement_errors(spark, sf_dir):
    """What must be refused, and as what: the create matrix, drops of what isn't there, and changes of rows or through views."""
    ds = _datastore(spark)
    ds.create_topic("a", _EVENTS)
    ds.sql("CREATE SCHEMA s")
    ds.sql("CREATE VIEW s.v AS SELECT 1 AS one")
    found = []
    for sql in ("CREATE TABLE a (at TIMESTAMP)", "DROP TABLE b", "DROP SCHEMA s", "DROP SCHEMA t", "DROP CATALOG c", "CREATE VIEW IF NOT EXISTS a AS SELECT 1", "UPDATE a SET value = 1", "COPY a TO 'x'", "INSERT INTO s.v SELECT 1"):
        try:
            ds.sql(sql)
        except errors.StreamtableError as e:
            found.append((type(e).__name__,))
    return spark.createDataFrame(found, "error string")


@_query("topic_describe", "SELECT * FROM (VALUES ('time', 'timestamp'), ('k', 'int64'), ('x', 'float32')) t(column_name, data_type)")
def topic_describe(spark, sf_dir):
    ds = _datastore(spark)
    ds.create_topic("a", st.topic(st.column("k", st.int64), st.column("x", st.float32, row_shape=(2, 3))))
    return ds.sql("DESCRIBE a").select("column_name", "data_type")


@_query("explain_pushdown", "SELECT true AS scan, true AS filter_, true AS columns, true AS through_view, true AS limit_")
def explain_pushdown(spark, sf_dir):
    """EXPLAIN of queries over a topic and a view: filters, columns and limits reach the scan of the shards."""
    ds, _ = _filled(spark, sf_dir)
    ds.sql("CREATE VIEW high AS SELECT * FROM events WHERE value > 50")
    plan = ds.sql("EXPLAIN SELECT event_id FROM events WHERE user_id = 7 AND time < now()").first().plan
    view = ds.sql("EXPLAIN SELECT event_id FROM high WHERE user_id = 7").first().plan
    limit = ds.sql("EXPLAIN SELECT event_id FROM events LIMIT 3").first().plan
    row = ("Scan parquet" in plan, "EqualTo(user_id,7)" in plan and "LessThan(time" in plan, "event_type" not in plan.split("ReadSchema")[1].split("\n")[0], "GreaterThan(value,50.0)" in view and "EqualTo(user_id,7)" in view, "Limit" in limit)
    return spark.createDataFrame([row], "scan boolean, filter_ boolean, columns boolean, through_view boolean, limit_ boolean")


@_query("topic_history", "SELECT count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def topic_history(spark, sf_dir):
    t = _filled(spark, sf_dir)[1]
    return t.history(F.lit("2024-01-15 00:00:00").cast("timestamp")).agg(F.count(F.lit(1)).alias("n"))


@_query("registry_handles", "SELECT * FROM (VALUES ('a'), ('b'), ('c'), ('d')) t(table_name)")
def registry_handles(spark, sf_dir):
    """Two handles: one snapshots and drops the log, the other has fallen behind and goes on; a third reads after a restart."""
    ds = _datastore(spark)
    other = st.open(spark, ds.registry.store.root)
    ds.create_topic("a", _EVENTS)
    ds.create_topic("b", _EVENTS)
    ds.registry.snapshot(grace_ms=0)
    other.create_topic("c", _EVENTS)
    other.shutdown()
    ds.create_topic("d", _EVENTS)
    return st.open(spark, ds.registry.store.root).sql("SELECT table_name FROM information_schema.tables")


@_query("topic_rolled_shards", "SELECT count(*) AS n, true AS rolled, true AS sorted FROM events")
def topic_rolled_shards(spark, sf_dir):
    """Files of a shard end at the target size, and rows lie in the declared order within each."""
    ds = _datastore(spark)
    t = ds.create_topic("events", st.topic(*_EVENTS.columns[1:], index=("user_id",), config=st.TableConfig(target_shard_rows=500)))
    t.append(_events(spark, sf_dir))
    rows = t.read().select("time", "user_id", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag(F.struct("time", "user_id")).over(_window("file", "at"))
    ordered = rows.select((before <= F.struct("time", "user_id")).alias("up")).agg(F.coalesce(F.every("up"), F.lit(True)).alias("sorted"))
    row = (*sizes.agg(F.sum("n"), F.max("n") <= 500).first(), *ordered.first())
    return spark.createDataFrame([tuple(row)], "n long, rolled boolean, sorted boolean")


def _window(partition: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(partition).orderBy(order)


@_query("topic_maintained", "SELECT count(*) AS rows, 1 AS shards, 0::BIGINT AS held FROM events")
def topic_maintained(spark, sf_dir):
    """Maintenance merges the shards and clears what they were; metrics tell."""
    ds, _ = _filled(spark, sf_dir)
    ds.maintain(0)
    return ds.metrics().select("rows", "shards", "held")


@_query("stream_append", "SELECT epoch_us(ts) AS t, event_id FROM events WHERE value > 50")
def stream_append(spark, sf_dir):
    """One topic's stream appended to another, twice from one checkpoint: each row once."""
    ds, t = _filled(spark, sf_dir)
    high = ds.create_topic("high", _EVENTS)
    for _ in range(2):
        high.append_stream(t.subscribe().where("value > 50"), ds.registry.store.path("check")).awaitTermination()
    return high.read().select(F.unix_micros("time").alias("t"), "event_id")


@_query("stream_history_and_live", "SELECT event_id FROM events")
def stream_history_and_live(spark, sf_dir):
    """A stream takes what was there, through a compaction, and then what is appended."""
    ds, t = _filled(spark, sf_dir, 2)
    rows, (out, check) = t.read(), (ds.registry.store.path(x) for x in ("out", "check"))
    first = t.shards()
    live.run_to_parquet(t.subscribe(shards=first).select("event_id"), out, check)
    t.compact()
    t.append(rows.limit(0))
    t.append(_events(spark, sf_dir).limit(1).withColumn("event_id", F.lit(-1).cast("long")))
    return live.run_to_parquet(t.subscribe(shards=first).select("event_id"), out, check).where("event_id >= 0")


@_query("stream_new_only", "SELECT 3::BIGINT AS n")
def stream_new_only(spark, sf_dir):
    """A subscription without history has nothing of what was there."""
    ds, t = _filled(spark, sf_dir)
    stream = t.subscribe(history=False).select("event_id")
    t.append(spark.range(3).selectExpr("current_timestamp() + INTERVAL 1 HOUR AS time", "id AS event_id", "id AS user_id", "'new' AS event_type", "0D AS value"))
    return live.run_to_parquet(stream, ds.registry.store.path("out"), ds.registry.store.path("check")).agg(F.count(F.lit(1)).alias("n"))


@_query("t_scalar", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, len(list_filter(embedding, lambda v: v > 0))::INT AS n FROM embeddings")
def t_scalar(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    t = tn.Tensor.of(df, "embedding", (8, 8))
    one = t.slice(slice(0, 1), slice(0, 1)).to_standard_layout()
    return df.select("vec_id", F.round(one.scalar().cast("double"), 6).alias("x"), t.with_mask(t.gt(0.0)).nullable().num_valid().alias("n"))


@_query("t_valid_elements", "SELECT vec_id, i AS idx FROM (SELECT vec_id, embedding AS e, unnest(range(64)) AS i FROM embeddings) WHERE e[i + 1] > 0")
def t_valid_elements(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    t = tn.Tensor.of(df, "embedding", (8, 8))
    return t.with_mask(t.gt(0.0)).valid_elements(df, "vec_id").select("vec_id", F.col("idx").cast("long").alias("idx"))


@_query("udf_arrow", "SELECT c_custkey, length(c_name) * 2 AS n FROM customer")
def udf_arrow(spark, sf_dir):
    """A function of the user's own in SQL, on Arrow batches."""
    ds = _datastore(spark)

    @F.pandas_udf("long")
    def doubled(x):
        return x.str.len() * 2

    ds.session.udf.register("doubled", doubled)
    ds.session.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return ds.sql("SELECT c_custkey, doubled(c_name) AS n FROM customer")


@_query("fn_map", "SELECT n_nationkey, n_name AS name, 2 AS size, n_regionkey AS region FROM nation")
def fn_map(spark, sf_dir) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(m, "name").alias("name"), F.size(F.map_keys(m)).alias("size"), F.element_at(m, "region").cast("int").alias("region"))
