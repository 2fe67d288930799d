"""The registered queries, one or more for each operator, each with SQL that gives the same rows elsewhere.

Most are SQL that Spark plans as it stands; {name} is a table. Where the other engine writes something differently it has SQL of
its own. Sums of money are taken as decimals, so that they don't depend on the order of the rows.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import streamtable
from streamtable import errors
from streamtable.functions import scalar
from streamtable.operators import relational
from streamtable.operators import tensor as tn
from streamtable.plans.registry import new_id
from streamtable.streaming import live
from streamtable.types import column, float32, int64, string, topic

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str, text: str, other: str | None = None, check: bool = True) -> None:
    """Register a query by its SQL, and the other engine's, if it differs."""
    used = [t for t in TABLES if f"{{{t}}}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    if check:
        ORACLES[name] = (other or text).format(**{t: t for t in TABLES})


def _query(name: str, oracle: str | None):
    """Register a function as a query."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _ordered(name: str, text: str) -> None:
    """Register an ordered query whose rows carry their place in the result, so that a check free of order sees it."""
    used = [t for t in TABLES if f"{{{t}}}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
        # A limited result of at most 1,000 rows: numbered as it comes, in one partition, without a sort of its own.
        kind = ", ".join(f"{c} {t}" for c, t in df.dtypes)
        rows = df.limit(1000).collect()
        return spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], f"place long, {kind}")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT row_number() OVER () AS place, * FROM ({text.format(**{t: t for t in TABLES})})"


def _money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


# Scans, projections and filters

_sql("scan_project", "SELECT event_id, user_id, event_type FROM {events}")
_sql("filter_predicates", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity >= 45 AND l_discount < 0.02 AND NOT l_returnflag = 'N' OR l_tax IS NULL")
_sql("between_in_like", "SELECT p_partkey, p_name, p_brand FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') OR p_type LIKE '%STEEL'")
_sql("ilike_regex", "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment ILIKE 'b%' AND c_name RLIKE '[0-9]*7$'", "SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment ILIKE 'b%' AND regexp_matches(c_name, '[0-9]*7$')")
_sql("case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS STRING) AS key_text, CAST(CAST(o_custkey AS STRING) AS INT) + 1 AS next_key, COALESCE(TRY_CAST(o_orderstatus AS INT), TRY_CAST(right(o_orderpriority, 1) AS INT), -1) AS n FROM {orders}")
_sql("null_safe", "SELECT a.n_nationkey, NULLIF(a.n_regionkey, 1) IS NULL AS is_null, COALESCE(NULLIF(a.n_regionkey, 1), -1) AS region, NULLIF(a.n_regionkey, 1) IS NOT DISTINCT FROM NULLIF(b.r_regionkey, 1) AS same FROM {nation} a JOIN {region} b ON a.n_regionkey = b.r_regionkey")
_sql("limit_skip", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderkey NULLS LAST LIMIT 50 OFFSET 20")
_ordered("limit_skip_ordered", "SELECT o_custkey, o_orderkey FROM {orders} ORDER BY o_custkey DESC NULLS LAST, o_orderkey NULLS LAST LIMIT 50 OFFSET 20")
_sql("values_literal", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")

# Joins and subqueries

_sql("join_inner", f"SELECT n_name, count(*) AS n_orders, {_money('o_totalprice')} AS total FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
_sql("join_right", "SELECT s_suppkey, n_name FROM {nation} RIGHT JOIN {supplier} ON n_nationkey = s_nationkey AND n_regionkey < 2")
_sql("join_full", "SELECT a.c_custkey AS a_key, b.s_suppkey AS b_key FROM (SELECT * FROM {customer} WHERE c_acctbal > 5000) a FULL JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 0) b ON a.c_custkey = b.s_suppkey")
_sql("join_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM {customer} SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000")
_sql("join_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM {customer} ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000")
_sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
_sql("join_theta", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey + 1")
_sql("join_using", "SELECT doc_id, lang, quality FROM {documents} JOIN {labels} USING (doc_id)")
_sql("join_natural", "SELECT doc_id, source, toxic FROM {documents} NATURAL JOIN {labels}")
_sql("subq_scalar", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.01 FROM {part})")
_sql("subq_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
_sql("subq_exists", "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l_quantity > 49)")
_sql("subq_in", "SELECT count(*) AS n FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size = 1) AND l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P')")
_sql("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 12) SELECT c_custkey, n FROM top JOIN {customer} ON o_custkey = c_custkey")


@_query("join_broadcast", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast(spark, sf_dir):
    # nation has 25 rows at every scale.
    joined = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@_query("join_merge", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def join_merge(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").hint("merge").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_query("join_salted", "SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def join_salted(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return relational.salted_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, ["o_custkey"], 4).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@_query("join_asof", "SELECT a.event_id, b.value AS last_value, b.event_id AS last_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return relational.asof_join(left, right, "ts", "user_id").select("event_id", "last_value", "last_id")


@_query("join_asof_ranges", "SELECT a.event_id, b.event_id AS last_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY ts) b ON a.ts >= b.ts")
def join_asof_ranges(spark, sf_dir):
    """Without a key: ranges of time go to tasks of their own."""
    events = table(spark, sf_dir, "events")
    right = events.where("event_type <> 'purchase'").select("ts", F.col("event_id").alias("last_id"))
    return relational.asof_join(events.where("event_type = 'purchase'").select("event_id", "ts"), right, "ts", ranges=16).select("event_id", "last_id")


@_query("join_range", "SELECT e.event_id, s.band FROM events e JOIN (SELECT n_nationkey AS band, n_nationkey * 10.0 AS lo, n_nationkey * 10.0 + 15.0 AS hi FROM nation) s ON e.value >= s.lo AND e.value < s.hi")
def join_range(spark, sf_dir):
    bands = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("band"), (F.col("n_nationkey") * 10.0).alias("lo"), (F.col("n_nationkey") * 10.0 + 15.0).alias("hi"))
    return relational.range_join(table(spark, sf_dir, "events").select("event_id", "value"), bands, "value", "lo", "hi", 10.0).select("event_id", "band")


# Aggregates

_sql(
    "agg_basic",
    f"SELECT l_returnflag, l_linestatus, {_money('l_quantity')} AS sum_qty, {_money('l_extendedprice')} AS sum_base, count(*) AS n, count(l_tax) AS n_tax, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, "
    f"round(CAST({_money('l_quantity')} AS DOUBLE) / count(*), 6) AS avg_qty FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
)
_sql("agg_global", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(DISTINCT o_custkey) AS customers FROM {orders}")
_sql("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT year(o_orderdate)) AS BIGINT) AS years FROM {orders} GROUP BY o_orderstatus")
_sql("select_distinct", "SELECT DISTINCT p_brand, p_size FROM {part}")
_sql("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low FROM {events} GROUP BY event_type")
_sql("agg_having", "SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey HAVING count(*) > 55")
_sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderpriority) AS BIGINT) AS g FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("agg_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
_sql("agg_stats", "SELECT event_type, round(var_samp(value), 4) AS vs, round(var_pop(value), 4) AS vp, round(stddev_samp(value), 4) AS ss, round(stddev_pop(value), 4) AS sp, round(covar_samp(value, user_id), 2) AS cs, round(covar_pop(value, user_id), 2) AS cp, round(corr(value, user_id), 6) AS co FROM {events} GROUP BY event_type")
_sql("agg_median", "SELECT event_type, median(value) AS med FROM {events} GROUP BY event_type")
# Sketches differ between engines: what is compared is that they are near the exact value.
_sql("agg_approx_distinct", "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.15 * count(DISTINCT user_id) AS near FROM {events} GROUP BY event_type", "SELECT event_type, true AS near FROM {events} GROUP BY event_type")
_sql("agg_approx_percentile", "SELECT event_type, abs(percentile_approx(value, 0.5) - median(value)) <= 0.02 * (max(value) - min(value)) AS near FROM {events} GROUP BY event_type", "SELECT event_type, true AS near FROM {events} GROUP BY event_type")
_sql("agg_weighted_percentile", "SELECT event_type, round(percentile(value, 0.9, 1 + CAST(user_id % 3 AS INT)), 6) AS weighted FROM {events} GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS weighted FROM (SELECT event_type, value, unnest(range(1 + user_id % 3)) FROM {events}) GROUP BY event_type")
_sql("agg_bits_bools", "SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, bit_xor(o_custkey) AS x, bool_and(o_totalprice > 1000) AS every_, bool_or(o_totalprice > 400000) AS some_ FROM {orders} GROUP BY o_orderstatus")
_sql("agg_array", "SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
_sql("agg_first_last", "SELECT user_id, min_by(event_id, struct(ts, event_id)) AS first_id, max_by(event_id, struct(ts, event_id)) AS last_id FROM {events} GROUP BY user_id", "SELECT user_id, first(event_id ORDER BY ts, event_id) AS first_id, last(event_id ORDER BY ts, event_id) AS last_id FROM {events} GROUP BY user_id")
_sql("agg_pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM {orders}) PIVOT (count(1) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM {orders} GROUP BY o_orderpriority")

# Windows

_w = "OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST)"
_sql("win_rank_family", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM {orders} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST), v AS (PARTITION BY o_orderstatus ORDER BY o_custkey NULLS FIRST)")
_sql("win_ntile", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice NULLS FIRST, p_partkey NULLS FIRST) AS quarter FROM {part}")
_sql("win_lag_lead", f"SELECT event_id, lag(event_id) {_w} AS prev, lead(event_id, 2, -1) {_w} AS after_next FROM {{events}}")
_sql("win_first_last_nth", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS s FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_sql("win_rows_frame", "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM {events}")
_sql("win_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY unix_micros(CAST(ts AS TIMESTAMP)) NULLS FIRST RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM {events}", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) NULLS FIRST RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM {events}")


@_query("win_groups_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size NULLS FIRST GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS around FROM part")
def win_groups_frame(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return relational.over_groups(parts, F.sum("p_size"), "around", ["p_brand"], [F.col("p_size").asc_nulls_first()], 1, 1).select("p_partkey", "around")


# Sorts and sets

_sql("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 100")
_sql("sort_nulls", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM {nation} ORDER BY r DESC NULLS FIRST, n_nationkey ASC NULLS LAST")
_ordered("topk_ordered", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 100")
_ordered("sort_nulls_ordered", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM {nation} ORDER BY r DESC NULLS FIRST, n_nationkey ASC NULLS LAST LIMIT 1000")
_sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
_sql("union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
_sql("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 0")
_sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
_sql("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
_sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")

# Scalar functions

_sql(
    "fn_math",
    "SELECT p_partkey, abs(p_size - 25) AS a, round(cbrt(p_size), 9) AS cb, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, round(exp(p_size / 50.0), 9) AS ex, round(ln(p_size + 1), 9) AS l, round(log10(p_size + 1), 9) AS lt, "
    "round(log2(p_size + 1), 9) AS lb, round(power(p_size, 2), 6) AS pw, round(sqrt(p_size), 9) AS sq, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(atan2(p_size, 3), 9) AS at2, round(asin(p_size / 100.0), 9) AS asi, round(acos(p_size / 100.0), 9) AS aco, "
    "round(atan(p_size), 9) AS ata, round(sinh(p_size / 10.0), 6) AS sh, round(cosh(p_size / 10.0), 6) AS ch, round(tanh(p_size), 9) AS th, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd, CAST(sign(p_size - 25) AS INT) AS sg, round(pi(), 9) AS p FROM {part}",
)


@_query("fn_number_theory", "SELECT p_partkey, gcd(p_partkey, p_size)::BIGINT AS g, lcm(p_partkey, p_size)::BIGINT AS l, trunc(p_retailprice - 1500) AS t, factorial(p_size % 10)::BIGINT AS f FROM part")
def fn_number_theory(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.gcd(k, n).alias("g"), scalar.lcm(k, n).alias("l"), scalar.trunc(F.col("p_retailprice") - 1500).alias("t"), F.factorial(n % 10).alias("f"))


_sql(
    "fn_string",
    "SELECT c_custkey, ascii(c_name) AS a, bit_length(c_name) AS bl, trim(BOTH FROM concat('  ', c_name, ' ')) AS tr, char_length(c_name) AS cl, concat_ws('-', c_name, c_mktsegment) AS cw, left(c_name, 3) AS le, lower(c_name) AS lo, upper(c_mktsegment) AS up, lpad(c_mktsegment, 14, '*') AS lp, "
    "rpad(c_mktsegment, 14, '.') AS rp, ltrim('  x') AS lt, rtrim('x  ') AS rt, octet_length(c_name) AS ol, repeat('ab', 2) AS re, replace(c_name, '0', 'o') AS rep, reverse(c_name) AS rev, right(c_name, 4) AS ri, split_part(c_name, '#', 2) AS sp, startswith(c_name, 'Cust') AS st, substr(c_name, 2, 5) AS su, translate(c_name, '123', 'abc') AS tl, chr(65) AS ch FROM {customer}",
    "SELECT c_custkey, ascii(c_name) AS a, bit_length(c_name)::INT AS bl, trim(concat('  ', c_name, ' ')) AS tr, length(c_name)::INT AS cl, concat_ws('-', c_name, c_mktsegment) AS cw, left(c_name, 3) AS le, lower(c_name) AS lo, upper(c_mktsegment) AS up, lpad(c_mktsegment, 14, '*') AS lp, "
    "rpad(c_mktsegment, 14, '.') AS rp, ltrim('  x') AS lt, rtrim('x  ') AS rt, strlen(c_name)::INT AS ol, repeat('ab', 2) AS re, replace(c_name, '0', 'o') AS rep, reverse(c_name) AS rev, right(c_name, 4) AS ri, split_part(c_name, '#', 2) AS sp, starts_with(c_name, 'Cust') AS st, substr(c_name, 2, 5) AS su, translate(c_name, '123', 'abc') AS tl, chr(65) AS ch FROM {customer}",
)


@_query("fn_string_renamed", "SELECT c_custkey, strpos(c_name, '0')::INT AS p, lower(to_hex(c_custkey)) AS h, array_to_string(list_transform(string_split(lower(c_mktsegment), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i FROM customer")
def fn_string_renamed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.strpos(F.col("c_name"), F.lit("0")).alias("p"), scalar.to_hex(F.col("c_custkey")).alias("h"), F.initcap("c_mktsegment").alias("i"))


_sql("fn_regex", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_type, '[AEIOU]', '_') AS masked, p_name RLIKE '^[a-m]' AS early FROM {part}", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS masked, regexp_matches(p_name, '^[a-m]') AS early FROM {part}")
_sql("fn_hash", "SELECT item_id, md5(text) AS m, sha2(text, 256) AS s, regexp_replace(base64(CAST(text AS BINARY)), '[^A-Za-z0-9+/=]', '') AS b, lower(hex(CAST(text AS BINARY))) AS h FROM {benchmark}", "SELECT item_id, md5(text) AS m, sha256(text) AS s, base64(encode(text)) AS b, lower(hex(encode(text))) AS h FROM {benchmark}")


@_query("fn_digest", "SELECT item_id, lower(hex(unhex(sha256(text)))) AS d FROM benchmark")
def fn_digest(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.hex(scalar.digest(F.col("text"), "sha256"))).alias("d"))


_sql(
    "fn_datetime",
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, quarter(o_orderdate) AS q, CAST(extract(DOW FROM o_orderdate) - 1 AS INT) AS dow, unix_micros(date_trunc('month', CAST(o_orderdate AS TIMESTAMP))) AS month_start, unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS secs, unix_micros(timestamp_millis(o_orderkey)) AS ms, "
    "unix_micros(CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY) AS next_day FROM {orders}",
    "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, hour(o_orderdate)::INT AS h, quarter(o_orderdate)::INT AS q, dayofweek(o_orderdate)::INT AS dow, epoch_us(date_trunc('month', o_orderdate)) AS month_start, epoch_us(o_orderdate) // 1000000 AS secs, o_orderkey * 1000 AS ms, "
    "epoch_us(o_orderdate + INTERVAL 1 DAY) AS next_day FROM {orders}",
)


@_query("fn_date_bin", "SELECT event_id, epoch_us(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2000-01-01 00:05:00')) AS bin FROM events")
def fn_date_bin(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(scalar.date_bin(900_000_000, F.col("ts"), "2000-01-01 00:05:00")).alias("bin"))


_sql(
    "fn_array",
    "SELECT vec_id, size(embedding) AS n, array_contains(array(1, 2, label), 2) AS has, array_position(array(7, 8, 9), 8) AS pos, array_join(array_append(array('a', 'b'), 'c'), '-') AS joined, round(CAST(element_at(embedding, 3) AS DOUBLE), 6) AS third, size(slice(embedding, 2, 5)) AS five, array_join(array_remove(array('x', 'y', 'x'), 'x'), '') AS rest, array_join(concat(array('p'), array('q')), '') AS pq FROM {embeddings}",
    "SELECT vec_id, len(embedding)::INT AS n, list_contains([1, 2, label], 2) AS has, list_position([7, 8, 9], 8)::BIGINT AS pos, array_to_string(list_append(['a', 'b'], 'c'), '-') AS joined, round(embedding[3]::DOUBLE, 6) AS third, len(embedding[2:6])::INT AS five, 'y' AS rest, 'pq' AS pq FROM {embeddings}",
)


@_query("fn_array_renamed", "SELECT n_nationkey, '1,3' AS places, 'a-z-a' AS replaced, n_regionkey::VARCHAR || ',' || n_nationkey::VARCHAR AS trimmed FROM nation")
def fn_array_renamed(spark, sf_dir):
    a = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    keys = F.array("n_regionkey", "n_nationkey", F.lit(0))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(scalar.array_positions(a, "a").cast("array<string>"), ",").alias("places"), F.array_join(scalar.array_replace(a, "b", "z"), "-").alias("replaced"), F.array_join(scalar.trim_array(keys, 1).cast("array<string>"), ",").alias("trimmed"))


_sql("fn_struct", "SELECT n_nationkey, named_struct('k', n_nationkey, 'name', n_name).name AS name, typeof(n_nationkey) AS kind FROM {nation}", "SELECT n_nationkey, struct_pack(k := n_nationkey, name := n_name).name AS name, 'int' AS kind FROM {nation}")
_sql("fn_json", "SELECT event_id, get_json_object(props, '$.k') AS k, props IS NULL AS none FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NULL AS none FROM {events}")
_sql("unnest", "SELECT vec_id, pos AS idx, round(CAST(x AS DOUBLE), 6) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, x", "SELECT vec_id, i - 1 AS idx, round(embedding[i]::DOUBLE, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings})")

# Tensors: the embeddings as 8 x 8 matrices, results as rows of (vec_id, idx, value)


def _tensor_query(name: str, oracle: str, shape: tuple[int, ...] = (8, 8)):
    """oracle: the value at index i (from 0) of a result, of the list e. It also says how many, as in `value FOR n`."""
    value, n = oracle.rsplit(" FOR ", 1)
    sql = f"SELECT vec_id, i AS idx, round(({value})::DOUBLE, 5) + 0.0 AS value FROM (SELECT vec_id, embedding AS e, unnest(range({n})) AS i FROM embeddings)"

    def put(f):
        @_query(name, sql)
        def run(spark, sf_dir):
            df = table(spark, sf_dir, "embeddings")
            return f(tn.Tensor.of(df, "embedding", shape)).elements(df, "vec_id").select("vec_id", F.col("idx").cast("long").alias("idx"), (F.round(F.col("value").cast("double"), 5) + 0.0).alias("value"))

        return f

    return put


def _as_int(t: tn.Tensor) -> tn.Tensor:
    return t.map(lambda x: x.cast("int"), streamtable.int32)


_tensor_query("t_add_scalar", "e[i + 1]::DOUBLE + 1.5 FOR 64")(lambda t: t.map(lambda x: x, streamtable.float64) + 1.5)
_tensor_query("t_mul_tensor", "e[i + 1]::DOUBLE * e[(i % 8) * 8 + i // 8 + 1]::DOUBLE FOR 64")(lambda t: (d := t.map(lambda x: x, streamtable.float64)) * d.t())
_tensor_query("t_broadcast", "e[i // 8 + 1]::DOUBLE - e[56 + i % 8 + 1]::DOUBLE FOR 64")(lambda t: (d := t.map(lambda x: x, streamtable.float64)).index_axis(0, 0).unsqueeze(-1) - d.index_axis(0, -1).unsqueeze(0))
_tensor_query("t_compare", "(e[i + 1] > e[64 - i])::INT FOR 64", (64,))(lambda t: t.gt(t.invert_axis(0)).map(lambda x: x.cast("int"), streamtable.int32))
_tensor_query("t_mask_fill", "CASE WHEN e[i + 1] > 0 THEN e[i + 1] ELSE -9 END FOR 64")(lambda t: t.with_mask(t.gt(0.0)).fill_masked(-9.0))
_tensor_query("t_drop_mask", "e[(i % 8) * 8 + i // 8 + 1] FOR 64")(lambda t: t.with_mask(t.gt(0.0)).t().drop_mask())
_tensor_query("t_slice", "e[(i // 3 + 2) * 8 + i % 3 * 2 + 1 + 1] FOR 9")(lambda t: t.slice(slice(2, 5), slice(1, 7, 2)))
_tensor_query("t_slice_step_neg", "e[(6 - i // 8 * 2) * 8 + i % 8 + 1] FOR 24")(lambda t: t.slice_axis(0, 1, 7, -2))
_tensor_query("t_swap_axes", "e[(i % 8) * 8 + i // 8 + 1] FOR 64")(lambda t: t.swap_axes(0, 1))
_tensor_query("t_roll", "e[(i // 8 + 5) % 8 * 8 + i % 8 + 1] FOR 64")(lambda t: t.roll(0, 3))
_tensor_query("t_invert", "e[i // 8 * 8 + 7 - i % 8 + 1] FOR 64")(lambda t: t.invert_axis(1))
_tensor_query("t_concat", "e[CASE WHEN i % 16 < 8 THEN i // 16 * 8 + i % 8 ELSE (7 - i // 16) * 8 + i % 8 END + 1] FOR 128")(lambda t: tn.concat(1, [t, t.invert_axis(0)]))
_tensor_query("t_stack", "e[CASE WHEN i % 2 = 0 THEN i // 2 ELSE 63 - i // 2 END + 1] FOR 128", (64,))(lambda t: tn.stack(-1, [t, t.invert_axis(0)]))
_tensor_query("t_diag", "e[i * 9 + 1] FOR 8")(lambda t: t.diag())
_tensor_query("t_index_axis", "e[i * 8 + 3 + 1] FOR 8")(lambda t: t.index_axis(1, 3))
_tensor_query("t_collapse_axis", "e[56 + i + 1] FOR 8")(lambda t: t.collapse_axis(0, -1))
_tensor_query("t_reshape", "e[i + 1] FOR 64")(lambda t: t.reshape(4, 16).unsqueeze(0).squeeze(0).flatten())
_tensor_query("t_unary_math", "sin(e[i + 1]::DOUBLE) + cos(e[i + 1]::DOUBLE) + exp(e[i + 1]::DOUBLE) + power(2, e[i + 1]::DOUBLE) + abs(e[i + 1]::DOUBLE) + atan(e[i + 1]::DOUBLE) FOR 64")(lambda t: (d := t.map(lambda x: x, streamtable.float64)).sin() + d.cos() + d.exp() + d.exp2() + d.abs() + d.atan())
_tensor_query("t_unary_math_2", "tan(e[i + 1]::DOUBLE) + asin(e[i + 1]::DOUBLE / 4) + acos(e[i + 1]::DOUBLE / 4) + ln(e[i + 1]::DOUBLE ** 2 + 1) + log2(e[i + 1]::DOUBLE ** 2 + 2) + log10(e[i + 1]::DOUBLE ** 2 + 3) FOR 64")(
    lambda t: (d := t.map(lambda x: x, streamtable.float64)).tan() + (d / 4.0).asin() + (d / 4.0).acos() + (d * d + 1.0).ln() + (d * d + 2.0).log2() + (d * d + 3.0).log10()
)
_tensor_query("t_compare_all", "(e[i + 1] <> e[64 - i])::INT + 2 * (e[i + 1] >= e[64 - i])::INT + 4 * (e[i + 1] = e[64 - i])::INT + 8 * (e[i + 1] < e[64 - i])::INT + 16 * (e[i + 1] <= e[64 - i])::INT FOR 64", (64,))(
    lambda t: _as_int(t.ne(u := t.invert_axis(0))) + _as_int(t.gte(u)) * 2 + _as_int(t.eq(u)) * 4 + _as_int(t.lt(u)) * 8 + _as_int(t.lte(u)) * 16
)
_tensor_query("t_atan2", "atan2(e[i + 1]::DOUBLE, e[64 - i]::DOUBLE) FOR 64", (64,))(lambda t: (d := t.map(lambda x: x, streamtable.float64)).atan2(d.invert_axis(0)))
_tensor_query("t_bits", "xor((e[i + 1] > 0)::INT, 1) & 3 | 4 FOR 64")(lambda t: (t.gt(0.0).map(lambda x: x.cast("int"), streamtable.int32) ^ 1) & 3 | 4)
_tensor_query("t_divide", "CASE WHEN i = 0 THEN 'inf'::DOUBLE ELSE 1.0 / i END FOR 64", (64,))(lambda t: 1.0 / (t.map(lambda x: F.lit(0.0), streamtable.float64) + tn.arange(0.0, 64.0)).abs())
_tensor_query("t_int_divide", "trunc((i - 32) / 5.0) + ((i - 32) - trunc((i - 32) / 5.0) * 5) FOR 64", (64,))(lambda t: (n := t.map(lambda x: F.lit(0), int64) + tn.arange(0, 64) - 32) / 5 + n % 5)
_tensor_query("t_linspace", "i * 0.25 FOR 40", (64,))(lambda t: tn.linspace(0, 10, 40))
_tensor_query("t_range", "3 + 2 * i FOR 4", (64,))(lambda t: tn.arange(3, 10, 2))
_tensor_query("t_eye", "CASE WHEN i % 6 = 0 THEN 1 ELSE 0 END FOR 25", (64,))(lambda t: tn.eye(5))
_tensor_query("t_full", "CASE WHEN i < 4 THEN 7 WHEN i < 8 THEN 0 ELSE 1 END FOR 12", (64,))(lambda t: tn.concat(0, [tn.full((2, 2), 7.0), tn.zeros((2, 2)), tn.ones((2, 2))]))
_tensor_query("t_from_values", "[1.0, 2.0, 3.0, 4.0][i + 1] FOR 4", (64,))(lambda t: tn.literal([[1.0, 2.0], [3.0, 4.0]]))


@_query("t_compress", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INT AS n_valid, round(list_sum(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x > 0)), 4) AS total FROM embeddings")
def t_compress(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    t = tn.Tensor.of(df, "embedding", (8, 8))
    masked = t.with_mask(t.gt(0.0))
    return df.select("vec_id", F.size(masked.compress()).alias("n_valid"), F.round(masked.sum(), 4).alias("total"))


@_query("t_all_any", "SELECT vec_id, len(list_filter(embedding, lambda x: NOT x > -0.35)) = 0 AS all_, len(list_filter(embedding, lambda x: x > 0.35)) > 0 AS any_, NOT len(list_filter(embedding, lambda x: x > 0.35)) > 0 AS none_, len(embedding)::INT AS valid FROM embeddings")
def t_all_any(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    t = tn.Tensor.of(df, "embedding", (8, 8))
    high = t.gt(0.35)
    return df.select("vec_id", t.gt(-0.35).all().alias("all_"), high.any().alias("any_"), high.none().alias("none_"), t.mask().map(lambda x: F.when(x, 1), streamtable.int32).num_valid().alias("valid"))


@_query("t_reduce", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s, round(list_min(embedding)::DOUBLE, 6) AS lo, round(list_max(embedding)::DOUBLE, 6) AS hi, round(embedding[10]::DOUBLE, 6) AS at FROM embeddings")
def t_reduce(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    t = tn.Tensor.of(df, "embedding", (8, 8))
    r = lambda c, n=6: F.round(c.cast("double"), n)
    return df.select("vec_id", r(t.sum(), 4).alias("s"), r(t.min()).alias("lo"), r(t.max()).alias("hi"), r(t.index(1, 1)).alias("at"))


@_query("t_axis_iter", "SELECT vec_id, k AS row_, round(list_sum(list_transform(embedding[k * 8 + 1 : k * 8 + 8], lambda x: x::DOUBLE)), 4) + 0.0 AS total FROM (SELECT vec_id, embedding, unnest(range(8)) AS k FROM embeddings)")
def t_axis_iter(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    rows = F.array(*(F.struct(F.lit(k).cast("long").alias("row_"), (F.round(x.sum(), 4) + 0.0).alias("total")) for k, x in enumerate(tn.Tensor.of(df, "embedding", (8, 8)).unstack(0))))
    return df.select("vec_id", F.inline(rows))


# Topics, views and streams: each in a datastore of its own

_EVENTS = topic(column("event_id", int64), column("user_id", int64), column("event_type", string), column("value", streamtable.float64))
_DAY = "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _datastore(spark: SparkSession) -> streamtable.Datastore:
    """A datastore below the shared folder, removed when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise errors.StreamtableError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="streamtable-")
        atexit.register(shutil.rmtree, root, True)
    ds = streamtable.open(spark, f"{root.rstrip('/')}/datastore-{new_id()}", create=True)
    atexit.register(_remove, ds)
    return ds


def _remove(ds: streamtable.Datastore) -> None:
    try:
        ds.registry.store.delete(ds.registry.store.root)
    except Exception:  # the JVM has gone first
        pass


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("time"), "event_id", "user_id", "event_type", "value")


def _filled(spark: SparkSession, sf_dir: str, parts: int = 3):
    """A datastore with the events in topic `events`, appended in a few shards."""
    ds = _datastore(spark)
    t = ds.create_topic("events", _EVENTS)
    rows = _events(spark, sf_dir)
    for k in range(parts):
        t.append(rows.where(F.pmod("event_id", F.lit(parts)) == k))
    return ds, t


def _by_day(df: DataFrame) -> DataFrame:
    out = live.windowed(df, "time", "1 day", {"n": F.count(F.lit(1)), "total": F.sum("value")}, ["event_type"])
    return out.select(F.unix_micros("window_start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("events_by_day", _DAY)
def events_by_day(spark, sf_dir):
    """Daily counts and sums of the events by type, from a plain scan."""
    return _by_day(_events(spark, sf_dir))


@_query("topic_roundtrip", "SELECT epoch_us(ts) AS t, event_id, user_id, event_type, value FROM events")
def topic_roundtrip(spark, sf_dir):
    return _filled(spark, sf_dir)[1].read().select(F.unix_micros("time").alias("t"), "event_id", "user_id", "event_type", "value")


@_query("topic_insert_into", "SELECT count(*) AS count FROM events WHERE value > 50")
def topic_insert_into(spark, sf_dir):
    ds, _ = _filled(spark, sf_dir)
    ds.create_topic("high", _EVENTS)
    return ds.sql("INSERT INTO high SELECT * FROM events WHERE value > 50")


@_query("topic_view", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type")
def topic_view(spark, sf_dir):
    ds, _ = _filled(spark, sf_dir)
    ds.sql("CREATE VIEW high AS SELECT * FROM events WHERE value > 50")
    return ds.sql("SELECT event_type, count(*) AS n FROM main.public.high GROUP BY event_type")


@_query("topic_view_on_view", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY user_id) WHERE n > 2")
def topic_view_on_view(spark, sf_dir):
    ds, _ = _filled(spark, sf_dir)
    ds.sql("CREATE SCHEMA derived")
    ds.sql("CREATE VIEW derived.high AS SELECT * FROM events WHERE value > 50")
    ds.sql("CREATE OR REPLACE VIEW derived.busy AS SELECT user_id, count(*) AS n FROM derived.high GROUP BY user_id")
    return ds.use_schema("derived").sql("SELECT user_id, n FROM busy WHERE n > 2")


@_query("topic_materialized_view", "SELECT event_type, max(value) AS top FROM events GROUP BY event_type")
def topic_materialized_view(spark, sf_dir):
    ds, _ = _filled(spark, sf_dir)
    ds.create_view("top", "SELECT event_type, max(value) AS top FROM events GROUP BY event_type", materialize=True, index=("event_type",))
    return ds.sql("SELECT * FROM top")


@_query("topic_compacted_scan", _DAY)
def topic_compacted_scan(spark, sf_dir):
    ds, t = _filled(spark, sf_dir)
    t.compact()
    t.vacuum(0)
    return _by_day(t.read())


@_query("topic_time_before_now", "SELECT count(*) AS n FROM events WHERE ts < now()::TIMESTAMP")
def topic_time_before_now(spark, sf_dir):
    return _filled(spark, sf_dir)[0].sql("SELECT count(*) AS n FROM events WHERE time < now()")


@_query("topic_time_after_now", "SELECT count(*) + 1 AS n FROM events WHERE ts > now()::TIMESTAMP")
def topic_time_after_now(spark, sf_dir):
    ds, _ = _filled(spark, sf_dir)
    ds.sql("INSERT INTO events SELECT now() + INTERVAL 1 DAY, 0, 0, 'later', 0")
    return ds.sql("SELECT count(*) AS n FROM events WHERE time > now()")


@_query("topic_tensor", "SELECT vec_id, round(embedding[9]::DOUBLE, 6) AS x FROM embeddings")
def topic_tensor(spark, sf_dir):
    ds = _datastore(spark)
    t = ds.create_topic("vectors", topic(column("vec_id", int64), column("x", float32, row_shape=(8, 8))))
    t.append(table(spark, sf_dir, "embeddings").select(F.lit("2024-01-01").cast("timestamp").alias("time"), "vec_id", F.col("embedding").alias("x")))
    df = ds.sql("SELECT vec_id, x FROM vectors")
    return df.select("vec_id", F.round(tn.Tensor.of(df, "x").index(1, 0).cast("double"), 6).alias("x"))


@_query("information_schema", "SELECT * FROM (VALUES ('events', 'BASE TABLE'), ('high', 'VIEW')) t(table_name, table_type)")
def information_schema(spark, sf_dir):
    ds = _datastore(spark)
    ds.create_topic("events", _EVENTS)
    ds.sql("CREATE VIEW high AS SELECT * FROM events WHERE value > 50")
    return ds.sql("SELECT table_name, table_type FROM information_schema.tables")


def _streamed(spark, sf_dir, build) -> DataFrame:
    ds, t = _filled(spark, sf_dir)
    return live.run_complete(build(t.subscribe()), ds.registry.store.path("out"), ds.registry.store.path("check"))


@_query("stream_available_now", "SELECT epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'click'")
def stream_available_now(spark, sf_dir):
    ds, t = _filled(spark, sf_dir)
    rows = t.subscribe().where("event_type = 'click'").select(F.unix_micros("time").alias("t"), "event_id")
    return live.run_to_parquet(rows, ds.registry.store.path("out"), ds.registry.store.path("check"))


@_query("stream_tumbling", _DAY)
def stream_tumbling(spark, sf_dir):
    return _streamed(spark, sf_dir, _by_day)


@_query("stream_sliding", "SELECT epoch_us(w) AS w, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY AS w FROM events, (SELECT unnest(range(2)) AS k)) GROUP BY w")
def stream_sliding(spark, sf_dir):
    build = lambda s: live.windowed(s, "time", "2 days", {"n": F.count(F.lit(1))}, slide="1 day").select(F.unix_micros("window_start").alias("w"), "n")
    return _streamed(spark, sf_dir, build)


@_query(
    "stream_session",
    "SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
)
def stream_session(spark, sf_dir):
    build = lambda s: live.sessions(s, "time", "6 hours", {"n": F.count(F.lit(1))}, ["user_id"]).select("user_id", F.unix_micros("session_start").alias("session_start"), "n")
    return _streamed(spark, sf_dir, build)




@_query(
    "stream_join",
    "SELECT a.event_id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 6 HOUR",
)
def stream_join(spark, sf_dir):
    """Two streams of one topic, joined by user and time, into Parquet files."""
    ds, t = _filled(spark, sf_dir)
    own = lambda kind: t.subscribe().where(F.col("event_type") == kind).select("time", "user_id", "event_id")
    both = live.stream_join(own("click"), own("purchase"), ["user_id"], "time", "time", "6 HOURS", "1000 DAYS")
    return live.run_to_parquet(both, ds.registry.store.path("out"), ds.registry.store.path("check")).select("event_id", F.col("right_event_id").alias("other_id"))


@_query("stream_late_rows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL 1 DAY, max(ts)) FROM events) GROUP BY 1")
def stream_late_rows(spark, sf_dir):
    """Windows in append mode, closed by a watermark: those before the last day come out, and rows that come late for one don't count.

    The second run has a copy of the first day's rows, which are behind the watermark, and the third nothing but a far later row.
    """
    ds = _datastore(spark)
    t = ds.create_topic("events", _EVENTS)
    rows = _events(spark, sf_dir)
    out, check = ds.registry.store.path("out"), ds.registry.store.path("check")

    def run() -> DataFrame:
        stream = live.with_watermark(t.subscribe(shards=[]), "time", "0 seconds")
        days = live.windowed(stream, "time", "1 day", {"n": F.count(F.lit(1))}).select(F.unix_micros("window_start").alias("day"), "n")
        return live.run_to_parquet(days, out, check)

    t.append(rows)
    run()
    first = rows.agg(F.min("time")).first()[0]
    t.append(rows.where(F.col("time") < F.lit(first) + F.expr("INTERVAL 1 DAY")))
    return run()


# The dialect's own function names, in a datastore's SQL


def _dialect(name: str, text: str, other: str) -> None:
    """Register a statement of a datastore that names the tables as they are."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = _datastore(spark)
        for t in used:
            ds.session.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return ds.sql(text)

    QUERIES[name] = run
    ORACLES[name] = other


_dialect(
    "sql_approx",
    "SELECT event_type, abs(approx_distinct(user_id) - count(DISTINCT user_id)) <= 0.15 * count(DISTINCT user_id) AS d, abs(approx_median(value) - median(value)) <= 0.02 * (max(value) - min(value)) AS m, "
    "abs(approx_percentile_cont(value, 0.9) - percentile(value, 0.9)) <= 0.02 * (max(value) - min(value)) AS p, round(approx_percentile_cont_with_weight(value, 1 + user_id % 3, 0.9), 6) AS w FROM events GROUP BY event_type",
    "SELECT event_type, true AS d, true AS m, true AS p, round(quantile_cont(value, 0.9), 6) AS w FROM (SELECT event_type, value, unnest(range(1 + user_id % 3)) FROM events) GROUP BY event_type",
)
_dialect(
    "sql_numbers",
    "SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l, trunc(p_retailprice - 1500) AS t, trunc(p_retailprice, 1) AS t1, factorial(p_size % 10) AS f, round(log(2, p_size + 1), 9) AS lo, round(asinh(p_size), 9) AS sh, "
    "round(acosh(p_size), 9) AS ch, round(atanh(p_size / 100.0), 9) AS th, random() BETWEEN 0 AND 1 AS rnd FROM part",
    "SELECT p_partkey, gcd(p_partkey, p_size)::BIGINT AS g, lcm(p_partkey, p_size)::BIGINT AS l, trunc(p_retailprice - 1500) AS t, trunc(p_retailprice * 10) / 10 AS t1, factorial(p_size % 10)::BIGINT AS f, round(log2(p_size + 1), 9) AS lo, round(asinh(p_size), 9) AS sh, "
    "round(acosh(p_size), 9) AS ch, round(atanh(p_size / 100.0), 9) AS th, true AS rnd FROM part",
)
_dialect(
    "sql_strings",
    "SELECT c_custkey, strpos(c_name, '0') AS p, to_hex(c_custkey) AS h, btrim(concat('xx', c_name, 'x'), 'x') AS b, starts_with(c_name, 'Cust') AS s, regexp_match(c_name, '([A-Za-z]+)#0*([0-9]+)')[1] AS digits, regexp_match(c_name, '[a-z]+')[0] AS lowered, regexp_match(c_name, 'nothing') IS NULL AS missed, substring(c_name, 3, 4) AS sub FROM customer",
    "SELECT c_custkey, strpos(c_name, '0')::INT AS p, lower(to_hex(c_custkey)) AS h, trim('xx' || c_name || 'x', 'x') AS b, starts_with(c_name, 'Cust') AS s, regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) AS digits, regexp_extract(c_name, '[a-z]+') AS lowered, true AS missed, substring(c_name, 3, 4) AS sub FROM customer",
)
_dialect(
    "sql_digests",
    "SELECT item_id, encode(sha256(text), 'hex') AS s2, encode(digest(text, 'sha256'), 'hex') AS d2, encode(digest(text, 'md5'), 'hex') AS m, length(sha224(text)) AS n224, length(sha384(text)) AS n384, length(sha512(text)) AS n512, encode(text, 'hex') AS h, encode(text, 'base64') AS b, decode(encode(text, 'hex'), 'hex') = CAST(text AS BINARY) AS back FROM benchmark",
    "SELECT item_id, sha256(text) AS s2, sha256(text) AS d2, md5(text) AS m, 28 AS n224, 48 AS n384, 64 AS n512, lower(hex(encode(text))) AS h, regexp_replace(base64(encode(text)), '=', '', 'g') AS b, true AS back FROM benchmark",
)
_dialect(
    "sql_times",
    "SELECT o_orderkey, unix_micros(to_timestamp_millis(o_orderkey)) AS ms, unix_micros(to_timestamp_micros(o_orderkey)) AS us, unix_micros(to_timestamp_seconds(o_orderkey)) AS s, unix_micros(to_timestamp_millis('2024-05-06 07:08:09')) AS t, unix_micros(from_unixtime(o_orderkey)) AS u, unix_micros(date_bin(INTERVAL '15' MINUTE, CAST(o_orderdate AS TIMESTAMP))) AS bin, "
    "CAST(date_part('year', o_orderdate) AS INT) AS y, current_date() = CAST(now() AS DATE) AS today FROM orders",
    "SELECT o_orderkey, o_orderkey * 1000 AS ms, o_orderkey::BIGINT AS us, o_orderkey * 1000000 AS s, epoch_us(TIMESTAMP '2024-05-06 07:08:09') AS t, o_orderkey * 1000000 AS u, epoch_us(time_bucket(INTERVAL 15 MINUTE, o_orderdate)) AS bin, year(o_orderdate)::INT AS y, true AS today FROM orders",
)
_dialect(
    "sql_arrays",
    "SELECT n_nationkey, array_length(make_array(1, 2, n_regionkey)) AS n, array_to_string(array_concat(make_array(n_regionkey), make_array(7, 8)), '-') AS joined, array_to_string(array_dims(make_array(make_array(1, 2, 3), make_array(4, 5, 6))), ',') AS dims, array_length(make_array(make_array(1, 2, 3)), 2) AS inner_, "
    "array_ndims(make_array(make_array(n_regionkey))) AS nd, array_to_string(array_positions(make_array(1, n_regionkey, 1), 1), ',') AS at, array_to_string(array_replace(make_array(1, 2, n_regionkey), 2, 9), ',') AS rep, array_to_string(trim_array(make_array(n_regionkey, 5, 6), 2), ',') AS trimmed, "
    "array_to_string(array_prepend(make_array(2, 3), 1), ',') AS pre, cardinality(make_array(1, 2)) AS card, arrow_typeof(n_name) AS kind, arrow_typeof(CAST(n_nationkey AS BIGINT)) AS kind_2 FROM nation",
    "SELECT n_nationkey, 3 AS n, n_regionkey || '-7-8' AS joined, '2,3' AS dims, 3 AS inner_, 2 AS nd, CASE WHEN n_regionkey = 1 THEN '1,2,3' ELSE '1,3' END AS at, '1,9,' || CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS rep, n_regionkey::VARCHAR AS trimmed, '1,2,3' AS pre, 2 AS card, 'Utf8' AS kind, 'Int64' AS kind_2 FROM nation",
)
_dialect("sql_unnest", "SELECT vec_id, round(CAST(x AS DOUBLE), 6) AS x FROM (SELECT vec_id, UNNEST(embedding) AS x FROM embeddings)", "SELECT vec_id, round(x::DOUBLE, 6) AS x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)")
_dialect("sql_unnest_from", "SELECT n_nationkey, t.v FROM nation , LATERAL UNNEST(make_array(n_regionkey, 10)) AS t(v)", "SELECT n_nationkey, unnest([n_regionkey, 10]) AS v FROM nation")
