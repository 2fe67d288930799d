import datetime as dt
import math

from pyspark.sql import functions as F

from streamtable import queries
from streamtable.functions import scalar
from streamtable.operators import relational
from streamtable.streaming import live
from tests.conftest import DATA


def test_asof(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 2, "z"), (None, 3, "n")], "k string, t int, l string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("b", 3, 30), (None, 1, 7), ("a", 4, 39)], "k string, t int, v int")
    assert {r.l: r.v for r in relational.asof_join(left, right, "t", "k").collect()} == {"x": 10, "y": 40, "z": None, "n": 7}
    assert {r.l: r.v for r in relational.asof_join(left, right, "t", "k", strict=True).collect()} == {"x": None, "y": 40, "z": None, "n": 7}
    assert relational.asof_join(left.limit(0), right, "t", "k").count() == 0


def test_asof_ranges(spark):
    """Cut into ranges of time, with a key or without, and with ties at the cuts, it is the same join."""
    left = spark.range(400).selectExpr("id AS l", "IF(id % 3 = 0, NULL, id % 3) AS k", "CAST(id * 37 % 100 AS INT) AS t")
    right = spark.range(120).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS k", "CAST(20 + id * 13 % 60 AS INT) AS t", "id AS v")
    for by in ("k", []):
        for strict in (False, True):
            found = [sorted(map(tuple, relational.asof_join(left if by else left.drop("k"), right if by else right.drop("k"), "t", by, strict=strict, ranges=n).select("l", "v").collect())) for n in (1, 7, 200)]
            assert found[0] == found[1] == found[2]
    assert relational.asof_join(left, right.limit(0), "t", "k", ranges=5).where("v IS NULL").count() == 400


def test_range_join(spark):
    points = spark.createDataFrame([(float(k),) for k in range(-5, 30)], "p double")
    spans = spark.createDataFrame([("a", 0.0, 10.0), ("b", 5.0, 25.5), ("c", 3.0, 3.0), ("d", -4.0, -1.0)], "n string, lo double, hi double")
    got = {(r.p, r.n) for r in relational.range_join(points, spans, "p", "lo", "hi", 7.0).collect()}
    assert got == {(float(p), n) for p in range(-5, 30) for n, lo, hi in (("a", 0, 10), ("b", 5, 25.5), ("d", -4, -1)) if lo <= p < hi}


def test_salted_join(spark):
    left = spark.range(100).selectExpr("id", "IF(id < 90, 0, id) AS k")
    right = spark.range(50).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, "k", how).select("id").collect()))
        assert sorted(map(tuple, relational.salted_join(left, right, ["k"], 5, how).select("id").collect())) == want


def test_groups_frame(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (4, 1)], "o int, v int")
    got = relational.over_groups(df, F.sum("v"), "s", [], [F.col("o").asc()], 1, 0).collect()
    assert sorted((r.o, r.v, r.s) for r in got) == [(1, 10, 30), (1, 20, 30), (2, 5, 35), (4, 1, 6)]


def test_functions(spark):
    pairs = [(12, 18), (0, 5), (-4, 6), (7, 13), (2**62, 2**40 * 3), (None, 1), (0, 0)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select(scalar.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r.g for r in got] == [None if a is None else math.gcd(a, b) for a, b in pairs]
    small = df.where("a < 100").select("a", "b", scalar.lcm(F.col("a"), F.col("b")).alias("l")).collect()
    assert all(r.l == math.lcm(r.a, r.b) for r in small)
    one = spark.range(1)
    assert one.select(scalar.trunc(F.lit(-1.57), 1)).first()[0] == -1.5
    before = one.select(scalar.date_bin(900_000_000, F.lit("1969-12-31 23:50:00").cast("timestamp"))).first()[0]
    assert before == dt.datetime(1969, 12, 31, 23, 45)
    assert one.select(scalar.array_positions(F.array(*map(F.lit, "aba")), "a")).first()[0] == [1, 3]
    assert one.select(scalar.trim_array(F.array(F.lit(1)), 3)).first()[0] == []


def test_stream_windows_match_batch(spark, tmp_path):
    schema = "k string, t timestamp, v int"
    rows = [("a", dt.datetime(2024, 1, 1, 0, m), m) for m in range(0, 60, 7)] + [("b", dt.datetime(2024, 1, 1, 3), 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    build = lambda d: live.windowed(d, "t", "20 minutes", {"n": F.count(F.lit(1)), "s": F.sum("v")}, ["k"], "10 minutes")
    got = live.run_available(build(live.with_watermark(stream, "t", "1 hour")), "w1", str(tmp_path / "c1"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(spark.createDataFrame(rows, schema)).collect()))
    gaps = lambda d: live.sessions(d, "t", "10 minutes", {"n": F.count(F.lit(1))}, ["k"])
    got = live.run_available(gaps(stream), "w2", str(tmp_path / "c2"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, gaps(spark.createDataFrame(rows, schema)).collect()))
    joined = live.stream_join(stream, stream, ["k"], "t", "t", "5 MINUTES", "1 hour")
    assert joined.columns == ["k", "t", "v", "right_t", "right_v"]
    got = live.run_to_parquet(joined, str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert sorted((r.k, r.v, r.right_v) for r in got.collect()) == sorted((k, v, v) for k, _, v in rows)


def test_complete_results_stay_off_the_driver(spark, tmp_path):
    """Batch by batch, again from a checkpoint with and without new rows, and over what a failed run has left."""
    schema, root = "k string, t timestamp, v int", str(tmp_path / "in")
    rows = [("a", dt.datetime(2024, 1, 1, 0, m), m) for m in range(0, 60, 7)] + [("b", dt.datetime(2024, 1, 1, 3), 1)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
    gaps = lambda d: live.sessions(d, "t", "10 minutes", {"n": F.count(F.lit(1))}, ["k"])
    out, put = tmp_path / "out", lambda x: spark.createDataFrame(x, schema).coalesce(1).write.mode("append").parquet(root)

    def run(check="check"):
        got = live.run_complete(gaps(stream), str(out), str(tmp_path / check))
        return got, sorted(map(tuple, got.collect()))

    assert run()[1] == []
    for k in range(3):
        put(rows[k::3])
    got, found = run()
    assert found == run()[1] == sorted(map(tuple, gaps(spark.createDataFrame(rows, schema)).collect())) and got.inputFiles()
    assert len(list(out.iterdir())) == 2
    (out / f"{3:020d}").mkdir()
    (out / f"{3:020d}" / "part-left.parquet").write_text("half")
    put([("b", dt.datetime(2024, 1, 1, 3, 5), 2)])
    more = sorted(map(tuple, gaps(spark.createDataFrame([*rows, ("b", dt.datetime(2024, 1, 1, 3, 5), 2)], schema)).collect()))
    assert run()[1] == more and run("another")[1] == more


def test_registered_streams_keep_no_result_on_the_driver(spark):
    for name in ("stream_session", "stream_sliding", "stream_tumbling"):
        assert queries.QUERIES[name](spark, DATA).inputFiles(), name
