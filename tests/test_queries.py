"""Every registered query against its SQL, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from streamtable import engine_queries as _  # noqa: F401
from streamtable import queries
from tests.conftest import DATA


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return float(v) if isinstance(v, Decimal) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, other, name):
    df = queries.QUERIES[name](spark, DATA)
    found = df.collect()
    if name not in queries.ORACLES:
        assert found
        return
    result = other.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, result.fetchall())


def test_pushdown(spark):
    plan = queries.QUERIES["scan_project"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
    plan = queries.QUERIES["filter_predicates"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_divide_takes_nothing_from_the_elements(spark, tmp_path):
    """Its SQL reads none, so NaN, infinities, nulls and zeros below zero don't show in its quotients."""
    odd = [float("nan"), float("inf"), float("-inf"), None, -0.0, 1.0, -2.5, 0.0]
    df = spark.createDataFrame([(1, odd * 8), (2, [None] * 64), (3, [0.5] * 64)], "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    result = duckdb.execute(queries.ORACLES["t_divide"].replace("embeddings", f"'{tmp_path}/embeddings.parquet/*.parquet'"))
    columns = [d[0] for d in result.description]
    got = queries.QUERIES["t_divide"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(columns, result.fetchall())
