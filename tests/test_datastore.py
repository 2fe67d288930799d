import datetime as dt
import threading

import numpy as np
import pytest

import streamtable as st
from streamtable import errors
from streamtable.plans import statements
from streamtable.plans.registry import Registry, new_id


def info(**k):
    return st.topic(st.column("x", st.float32, row_shape=(2, 3)), st.column("s", "string"), **k)


def plain():
    return st.topic(st.column("k", st.int64))


def test_open_needs_create(spark, tmp_path):
    with pytest.raises(errors.StreamtableError):
        st.open(spark, str(tmp_path / "none"))


def test_create_matrix(store):
    a = store.create_topic("a", plain())
    assert store.create_topic("a", plain(), if_not_exists=True).id == a.id
    with pytest.raises(errors.TableExists):
        store.create_topic("a", plain())
    with pytest.raises(errors.StreamtableError, match="not both"):
        store.create_topic("a", plain(), if_not_exists=True, or_replace=True)
    assert store.create_topic("a", plain(), or_replace=True).id != a.id
    store.sql("CREATE VIEW v AS SELECT * FROM a")
    with pytest.raises(errors.TableKindError):
        store.create_topic("v", plain(), if_not_exists=True)
    assert store.create_topic("v", plain(), or_replace=True).kind == "topic"
    assert store.create_topic("b", plain(), if_not_exists=True, or_replace=True).kind == "topic"


def test_drops(store):
    store.create_topic("a", plain())
    store.sql("CREATE VIEW v AS SELECT 1 AS x")
    with pytest.raises(errors.TableNotFound):
        store.sql("DROP TABLE v")
    with pytest.raises(errors.TableNotFound):
        store.sql("DROP VIEW a")
    store.sql("DROP TABLE IF EXISTS nothing")
    store.sql("CREATE SCHEMA w")
    store.sql("CREATE SCHEMA IF NOT EXISTS w")
    with pytest.raises(errors.SchemaExists):
        store.sql("CREATE SCHEMA w")
    store.sql("CREATE VIEW w.v AS SELECT 2 AS y")
    with pytest.raises(errors.SchemaNotEmpty):
        store.sql("DROP SCHEMA w")
    store.sql("DROP SCHEMA w CASCADE")
    with pytest.raises(errors.SchemaNotFound):
        store.sql("DROP SCHEMA w")
    store.sql("CREATE DATABASE c")
    store.sql("CREATE VIEW c.public.v AS SELECT 3 AS z")
    assert store.sql("SELECT z FROM c.public.v").first().z == 3
    assert store.use_catalog("c").sql("SELECT z FROM v").first().z == 3
    store.sql("DROP CATALOG c CASCADE")
    with pytest.raises(errors.CatalogNotFound):
        store.use_catalog("c")
    assert "main" in store.registry.catalogs


def test_publish_and_read(store):
    a = store.tables.get_or_create("a", info())
    with a.publish() as pb:
        pb.write(np.arange(6).reshape(2, 3), "r0")
        pb.write(x=np.ma.masked_array(np.ones((2, 3)), [[1, 0, 0], [0, 0, 0]]), s=None)
        pb.write_batch(s=["u", "v"], x=np.ones((2, 2, 3)))
        with pytest.raises(TypeError):
            pb.write(1, s="x")
        with pytest.raises(errors.DataTypeError):
            pb.write(np.ones((3, 2)), "wrong")
    frame = store.execute("SELECT x, s FROM a ORDER BY s NULLS FIRST")
    assert frame["x"].shape == (4, 2, 3) and frame["x"].dtype == st.float32
    assert frame["x"].to_numpy()[0].mask[0, 0] and frame["x"].to_numpy()[1].tolist() == [[0, 1, 2], [3, 4, 5]]
    assert frame["s"].to_arrow().to_pylist() == [None, "r0", "u", "v"]
    assert "time" in frame.pretty() or frame.ncols == 2
    assert len(list(store.query("SELECT s FROM a").skip(1).limit(2).rows())) == 2
    with pytest.raises(errors.DataTypeError):
        frame.col("s", st.int64)


def test_stream_of_batches(store):
    store.create_topic("a", plain())
    store.sql("INSERT INTO a SELECT timestamp'2024-01-01 05:00:00', id FROM range(5)")
    q = store.query("SELECT * FROM a ORDER BY k")
    assert [b.num_rows for b in q.stream(2)] == [2, 2, 1]
    frames = list(q)
    assert frames[0].nrows == 5 and frames[0]["k"].to_arrow().to_pylist() == [0, 1, 2, 3, 4]
    assert frames[0].to_arrow().equals(q.execute().to_arrow().cast(frames[0].arrow_schema()))


def test_required_and_sizes_are_checked(store, spark):
    a = store.create_topic("a", info())
    bad = spark.createDataFrame([(dt.datetime(2024, 1, 1), [1.0], "s")], "time timestamp, x array<double>, s string")
    with pytest.raises(Exception, match="6 elements"):
        a.append(bad)
    with pytest.raises(errors.DataTypeError):
        a.append(spark.createDataFrame([("s",)], "s string"))
    with pytest.raises(errors.DataTypeError):
        a.append(spark.createDataFrame([(dt.datetime(2024, 1, 1), 1)], "time timestamp, other int"))
    assert a.shards() == [] and a.read().count() == 0
    with pytest.raises(errors.InvalidIndex):
        st.topic(st.column("k", st.int64), index=("nope",))


def test_views_are_read_only_and_bound(store):
    store.create_topic("a", plain())
    store.sql("INSERT INTO a SELECT timestamp'2024-01-01', 5")
    view = store.query("SELECT k FROM a").create_view("v")
    with pytest.raises(errors.TableKindError):
        view.append(store.sql("SELECT 1"))
    with pytest.raises(errors.TableKindError):
        store.sql("INSERT INTO v SELECT 1")
    assert store.sql("INSERT INTO a (k, time) VALUES (6, timestamp'2024-01-02')").first()["count"] == 1
    assert sorted(r.k for r in store.sql("SELECT v.k FROM main.public.v").collect()) == [5, 6]
    assert store.sql("SELECT x.k FROM main.public.v x JOIN public.a ON x.k = a.k WHERE 'main.public.v' <> 'a'").count() == 2
    with pytest.raises(errors.StreamtableError):
        store.create_view("w", "SELECT 1", index=("x",))
    with pytest.raises(Exception):
        store.sql("CREATE VIEW broken AS SELECT nothing FROM a")
    with pytest.raises(errors.TableKindError):
        store.sql("DELETE FROM a")


def test_restart_and_snapshot(store, spark):
    store.create_topic("a", plain(), )
    store.sql("INSERT INTO a SELECT timestamp'2024-01-01', 1")
    root = store.registry.store.root
    assert st.open(spark, root).sql("SELECT count(*) AS n FROM a").first().n == 1
    store.shutdown()
    log = store.registry.store.path("log")
    assert store.registry.store.names(log)  # in its grace time
    store.registry.snapshot(grace_ms=0)
    assert store.registry.store.names(log) == []
    again = st.open(spark, root)
    again.sql("INSERT INTO a SELECT timestamp'2024-01-02', 2")
    store.registry.refresh()
    assert store.sql("SELECT sum(k) AS s FROM a").first().s == 3


def test_two_writers(store, spark):
    store.create_topic("a", plain())
    other = Registry(store.registry.store)
    name = ("main", "public", "a")
    table = other.table(name)["id"]
    store.registry.swap_shards(name, table, [{"id": "1", "path": "live/1", "rows": 1}])
    other.swap_shards(name, table, [{"id": "2", "path": "live/2", "rows": 1}])
    store.registry.refresh()
    assert [s["id"] for s in store.registry.table(name)["shards"]] == ["1", "2"]
    with pytest.raises(errors.ConcurrentChange):
        other.swap_shards(name, table, [], ["3"])


def test_handle_behind_a_snapshot(store, spark):
    """A handle that knows nothing of a snapshot and the removed log takes it up, and what it commits isn't lost."""
    root = store.registry.store.root
    behind = st.open(spark, root)
    for name in "abc":
        store.create_topic(name, plain())
    store.registry.snapshot(grace_ms=0)
    with pytest.raises(errors.ConcurrentChange):
        behind.registry.commit({"kind": "create_schema", "catalog": "main", "schema": "lost"})
    behind.create_topic("d", plain())
    assert st.open(spark, root).tables.names() == ["a", "b", "c", "d"]
    behind.registry.snapshot(grace_ms=0)
    store.create_topic("e", plain())
    assert behind.tables.names() == st.open(spark, root).tables.names() == ["a", "b", "c", "d", "e"]


def test_writer_killed_while_writing(store, spark, monkeypatch):
    """A file shows whole or not at all."""
    s = store.registry.store
    monkeypatch.setattr(type(s), "_place", lambda self, beside, path: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.create_schema("half")
    monkeypatch.undo()
    log = s.path("log")
    out = s._fs.create(s._at(f"{log}/.{99:020d}.json-killed"), False)
    out.close()
    store.create_schema("whole")
    assert "whole" in st.open(spark, s.root).registry.catalogs["main"] and "half" not in st.open(spark, s.root).registry.catalogs["main"]
    with pytest.raises(errors.ConcurrentChange):
        s.write_json(f"{log}/{0:020d}.json", {})


def test_crash_between_commit_and_rename(store, spark, monkeypatch):
    a = store.create_topic("a", plain())
    monkeypatch.setattr(type(a), "_settle", lambda self, shards: None)
    store.sql("INSERT INTO a SELECT timestamp'2024-01-01', 1")
    monkeypatch.undo()
    s = store.registry.store
    assert not s.names(f"{a.root}/live") and s.names(f"{a.root}/staged")
    assert [r.k for r in st.open(spark, s.root).sql("SELECT k FROM a").collect()] == [1]
    assert s.names(f"{a.root}/live") and not s.names(f"{a.root}/staged")


def test_failed_commit_is_unseen(store, monkeypatch):
    a = store.create_topic("a", plain())
    monkeypatch.setattr(type(store.registry), "swap_shards", lambda *_, **__: (_ for _ in ()).throw(OSError("no room")))
    with pytest.raises(OSError):
        store.sql("INSERT INTO a SELECT timestamp'2024-01-01', 1")
    monkeypatch.undo()
    s = store.registry.store
    assert not s.names(f"{a.root}/live") and not s.names(f"{a.root}/staged") and a.read().count() == 0


def test_batch_of_a_stream_is_appended_once(store, spark):
    """What a crash after the append leads to: the batch comes again."""
    a = store.create_topic("a", plain())
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1)], "time timestamp, k long")
    assert a.append(rows, ("stream", 0)) == 1
    assert a.append(rows, ("stream", 0)) == 0
    assert a.append(rows, ("stream", 1)) == 1
    assert a.append(rows, ("other", 0)) == 1
    assert a.read().count() == 3 and a.compact() == 3
    assert a.append(rows, ("stream", 1)) == 0 and a.read().count() == 3


def test_held_rows_are_read(store, spark):
    a = store.create_topic("a", info())
    with a.publish() as pb:
        pb.write(np.zeros((2, 3)), "row")
        pb.write_batch(x=np.ones((3, 2, 3), np.float32), s=["u", None, "w"])
        assert len(pb) == 4 and a.shards() == []
        assert sorted((r.s or "", r.x[0]) for r in store.sql("SELECT s, x FROM a").collect()) == [("", 1.0), ("row", 0.0), ("u", 1.0), ("w", 1.0)]
        assert st.open(spark, store.registry.store.root).sql("SELECT * FROM a").count() == 0
    assert store.sql("SELECT * FROM a").count() == 4 and len(a.shards()) == 1
    with pytest.raises(ZeroDivisionError):
        with a.publish() as pb:
            pb.write(np.zeros((2, 3)), "given up")
            1 / 0
    assert store.sql("SELECT * FROM a").count() == 4


def test_batches_of_arrays(store):
    kinds = {"i": "int32", "u": "uint64", "f": "float32", "b": "bool", "s": "string", "t": "timestamp"}
    a = store.create_topic("a", st.topic(*(st.column(n, k) for n, k in kinds.items()), st.column("x", "float64", row_shape=(2,))))
    at = [dt.datetime(2024, 1, 1, k, tzinfo=dt.timezone.utc) for k in range(3)]
    x = np.ma.masked_array(np.arange(6.0).reshape(3, 2), [[0, 1], [0, 0], [0, 0]])
    with a.publish() as pb:
        pb.write_batch(time=at, i=np.arange(3), u=[2**64 - 1, 0, None], f=np.ma.masked_array([1.5, 2.5, 3.5], [0, 0, 1]), b=np.array([True, False, True]), s=["p", None, "q"], t=at, x=x)
        with pytest.raises(errors.DataTypeError):
            pb.write_batch(x=np.zeros((3, 3)))
        with pytest.raises(errors.DataTypeError):
            pb.write_batch(time=[None], i=[1])
    rows = store.sql("SELECT * FROM a ORDER BY time").collect()
    assert [(r.i, r.f, r.b, r.s, r.x) for r in rows] == [(0, 1.5, True, "p", [0.0, None]), (1, 2.5, False, None, [2.0, 3.0]), (2, None, True, "q", [4.0, 5.0])]
    assert [r.u if r.u is None else int(r.u) for r in rows] == [2**64 - 1, 0, None]
    assert len(a.shards()) == 1


def test_frames_of_arrays(spark):
    f = st.Frame.of_arrays(k=np.arange(3), m=np.ma.masked_array([1.0, 2.0, 3.0], [0, 1, 0]), x=np.arange(12).reshape(3, 2, 2), s=["a", "b", "c"])
    assert f.nrows == 3 and f["x"].shape == (3, 2, 2) and f["m"].to_numpy().mask.tolist() == [False, True, False]
    back = st.Frame.of(f.to_df(spark))
    assert back["x"].to_numpy().tolist() == np.arange(12).reshape(3, 2, 2).tolist() and back["s"].to_arrow().to_pylist() == ["a", "b", "c"]
    with pytest.raises(errors.ShapeError):
        st.Frame.of_arrays(a=[1], b=[1, 2])


def test_plans_of_topics_and_views(store, spark):
    """Filters, columns and limits reach the shards' scan, through views too, and files outside a range of time are skipped."""
    a = store.create_topic("a", st.topic(st.column("k", st.int64), st.column("s", "string")))
    for day in (1, 2, 3):
        store.sql(f"INSERT INTO a SELECT timestamp'2024-01-0{day}' + make_interval(0, 0, 0, 0, 0, 0, id), id, 'x' FROM range(100)")
    store.sql("CREATE VIEW v AS SELECT time, k FROM a WHERE k > 5")
    plan = lambda sql: store.sql(sql)._jdf.queryExecution().executedPlan().toString()
    seen = plan("SELECT k FROM a WHERE k > 90 AND time < timestamp'2024-01-02'")
    assert "GreaterThan(k,90)" in seen and "LessThan(time," in seen and "ReadSchema: struct<time:timestamp,k:bigint>" in seen
    seen = plan("SELECT k FROM v WHERE k < 9")
    assert "GreaterThan(k,5)" in seen and "LessThan(k,9)" in seen and "s:string" not in seen
    assert "CollectLimit 3" in plan("SELECT k FROM a LIMIT 3")
    assert "LessThan(time," in plan("SELECT k FROM a WHERE time < now()")
    assert a.read().count() == 300


def test_materialized_views_have_rows_first(store):
    store.create_topic("a", plain())
    store.sql("INSERT INTO a SELECT timestamp'2024-01-01', 1")
    v = store.create_view("m", "SELECT k FROM a", materialize=True)
    for k in (2, 3, 4):
        store.sql(f"INSERT INTO a SELECT timestamp'2024-01-01', {k}")
        v.refresh()
        assert v.read().count() == k
    assert len(store.registry.store.names(v._folder())) == 2
    assert store.create_view("m", "SELECT k FROM a", if_not_exists=True, materialize=True).id == v.id
    with pytest.raises(errors.TableExists):
        store.create_view("m", "SELECT k FROM a", materialize=True)
    assert len(store.registry.store.names(store.registry.store.path("data"))) == 2


def test_dialect_errors(store):
    with pytest.raises(errors.StreamtableError, match="literal"):
        store.sql("SELECT digest('x', concat('m', 'd5'))")
    with pytest.raises(errors.StreamtableError, match="few"):
        store.sql("SELECT trim_array(make_array(1))")
    with pytest.raises(errors.StreamtableError, match="digest"):
        store.sql("SELECT digest('x', 'crc')")
    row = store.sql("SELECT 'sha256(1)' AS a, trunc(DATE'2024-05-06', 'MM') AS b /* unnest( */, array_ndims(array(1)) AS c, regexp_match('foobarbequebaz', '(bar)(beque)') AS d, regexp_match('a1', '\\\\d') AS e").first()
    assert row.a == "sha256(1)" and row.b == dt.date(2024, 5, 1) and row.c == 1 and row.d == ["bar", "beque"] and row.e == ["1"]


def test_ids_rise():
    out = []
    threads = [threading.Thread(target=lambda: out.extend(new_id() for _ in range(200))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(out)) == 800


def test_streams_see_each_row_once(store, spark):
    a = store.create_topic("a", plain())
    for k in range(3):
        store.sql(f"INSERT INTO a SELECT timestamp'2024-01-0{k + 1}', {k}")
    root = store.registry.store.path("check")

    def run(name, shards=None):
        q = a.subscribe(shards=shards).writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-c").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.k for r in spark.read.parquet(f"{root}/{name}").collect())

    first = a.shards()
    assert run("one", first) == [0, 1, 2]
    assert a.compact() == 3
    store.sql("INSERT INTO a SELECT timestamp'2024-01-09', 9")
    assert run("one", first) == [0, 1, 2, 9]
    assert run("two") == [0, 1, 2, 9]
    assert len(a.vacuum(0)) == 3
    assert run("three") == [0, 1, 2, 9]
    assert sorted(r.k for r in a.read().collect()) == [0, 1, 2, 9]
    only_new = a.subscribe(history=False)
    assert only_new.isStreaming


def test_shards_from_the_minimum_on_are_merged(store, spark):
    """Up to the target; one that is far larger than the others waits for more of them."""
    a = store.create_topic("a", st.topic(st.column("k", st.int64), config=st.TableConfig(min_shard_rows=2, target_shard_rows=20)))
    put = lambda *k: a.append(spark.createDataFrame([(dt.datetime(2024, 1, 1), x) for x in k], "time timestamp, k long"))
    sizes = lambda: sorted(s["rows"] for s in a.shards())
    for k in range(3):
        put(*range(3 * k, 3 * k + 3))
    store.maintain(0)
    assert sizes() == [9] and tuple(store.metrics().select("rows", "shards").first()) == (9, 1)
    put(9)
    assert a.compact() == 0 and sizes() == [1, 9]
    put(*range(10, 15))
    assert a.compact() == 2 and sizes() == [1, 14]
    put(*range(15, 27))
    assert a.compact() == 2 and sizes() == [1, 26]
    put(27)
    assert a.compact() == 2 and sizes() == [2, 26] and len(a.vacuum(0)) == 6
    assert sorted(r.k for r in a.read().collect()) == list(range(28))


def test_append_stream_and_temporary(store, spark):
    a = store.create_topic("a", plain())
    store.sql("INSERT INTO a SELECT timestamp'2024-01-01', 1")
    b = store.create_topic("b", plain())
    root = store.registry.store.path("check")
    for _ in range(2):
        b.append_stream(a.subscribe(), f"{root}/b").awaitTermination()
    assert b.read().count() == 1
    live = store.create_topic("live", st.topic(st.column("k", st.int64), temporary=True))
    live.append(a.read())
    assert live.read().count() == 0
    assert a.history().count() == 1 and a.history(dt.datetime(2020, 1, 1)).count() == 0


def test_statement_names(store):
    store.create_topic("a", plain())
    store.sql("CREATE SCHEMA w")
    store.sql("CREATE VIEW w.a AS SELECT 7 AS k")
    sql = "SELECT w.a.k, 'w.a' AS t FROM w.a -- w.a\nWHERE w.a.k > 1"
    out = statements.bound(store.registry, sql, "main", "public")
    assert out == "SELECT `a`.`k`, 'w.a' AS t FROM `main.w.a` AS `a` -- w.a\nWHERE `a`.`k` > 1"
    assert store.sql(sql).first().k == 7
    assert store.sql("DESCRIBE a").count() == 2
    assert "Scan" in store.sql("EXPLAIN SELECT * FROM a").first().plan or "LocalTableScan" in store.sql("EXPLAIN SELECT * FROM a").first().plan
    assert store.sql("SELECT gcd(12, 18) AS g, lcm(4, 6) AS l, strpos('abc', 'c') AS p").first() == (6, 12, 3)
    assert {r.column_name for r in store.sql("SELECT column_name FROM information_schema.columns WHERE table_schema = 'public'").collect()} == {"time", "k"}


def test_create_table_statements(store):
    store.sql("CREATE TABLE t (at TIMESTAMP NOT NULL, v DOUBLE)")
    store.sql("INSERT INTO t VALUES (timestamp'2024-01-01', 1.5)")
    assert store.sql("CREATE TABLE u AS SELECT at, v * 2 AS v FROM t").first()["count"] == 1
    assert store.sql("SELECT v FROM u").first().v == 3.0
    store.maintain(0)
    assert store.sql("SELECT v FROM u").first().v == 3.0


def test_row_classes(store):
    from dataclasses import dataclass
    from typing import Annotated

    @dataclass
    class Point:
        k: int
        v: Annotated[np.ndarray, st.float32, (2,)]
        s: str | None = None

    columns = st.columns_of(Point)
    assert [c.name for c in columns] == ["k", "v", "s"] and columns[1].row_shape == (2,) and columns[0].required and not columns[2].required
    t = store.create_topic("p", st.topic(*columns))
    with t.publish() as pb:
        pb.write(Point(1, np.array([1.0, 2.0])))
        pb.write(st.now(), Point(2, np.array([3.0, 4.0]), "x"))
    got = sorted(store.query("SELECT * FROM p").rows(Point), key=lambda p: p.k)
    assert [p.k for p in got] == [1, 2] and got[1].v.tolist() == [3.0, 4.0] and got[0].s is None


def test_config_and_maintenance(store, spark):
    import time

    config = st.Config(schema="own", table=st.TableConfig(write_batch_rows=7), maintenance_interval_s=0.2)
    store.create_schema("own")
    ds = st.open(spark, store.registry.store.root, config=config)
    assert ds.schema == "own" and ds.config is config and ds.use_schema("public").config is config
    a = ds.create_topic("a", plain())
    assert a.info.config.write_batch_rows == 7 and ds.resolve("a") == ("main", "own", "a")
    for k in range(3):
        ds.sql(f"INSERT INTO a SELECT timestamp'2024-01-01', {k}")
    with a.publish() as pb:
        pb.write(5)
        assert tuple(ds.metrics().first()) == ("main", "own", "a", 3, 3, 1, 7)
    ds.start_maintenance(older_than_s=0)
    ds.start_maintenance()
    for _ in range(200):
        if len(a.shards()) == 1:
            break
        time.sleep(0.2)
    ds.shutdown()
    assert ds.maintenance_error is None and len(a.shards()) == 1 and a.read().count() == 4


def test_typed_columns(store):
    store.create_topic("a", info())
    q = store.query("SELECT x, s FROM a")
    assert q.col3("x", st.float32).execute().columns == ["x"] and q.col1("s", st.string).execute().nrows == 0 and q.col_dyn("x").df.columns == ["x"]
    with pytest.raises(errors.ShapeError):
        q.col2("x")
    with pytest.raises(errors.DataTypeError):
        q.col1("s", st.int64)
    with pytest.raises(Exception):
        q.col1("nothing")


def test_prompt(store, spark, monkeypatch, capsys):
    from streamtable import __main__ as prompt

    lines = iter(["\\h", "SELECT id", "FROM range(5);", "SELECT nothing;", "\\q"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    monkeypatch.setattr(prompt, "SHOWN", 3)
    assert prompt.main([store.registry.store.root]) == 0 and prompt.main([]) == 0
    out = capsys.readouterr().out
    assert "semicolon" in out and "only the first 3 rows" in out and "AnalysisException" in out
