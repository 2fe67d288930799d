"""Sharding along a Hilbert curve.

Source, language and size class of a document are quantised to 5 bits each; the three numbers are a cell of a cube, and the
cell's place on the Hilbert curve is the first sort key. Near places on the curve are near in all three dimensions, so runs of
the order hold narrow ranges of each, and the minimum and maximum that Parquet keeps for a file skip most files for a filter on
any of them. Within a cell the order is by the text's hash, so equal texts lie together, and then by the id's hash, which
spreads one text's copies, however many, over tasks.

Rows are dealt out by range and numbered within each partition; a partition's first number comes from the counts of those
before it. So every row gets its exact place in the whole order, without any window over all rows, and runs are cut to give the
shards' counts, at most one apart (law `rows`). Only built-in functions are used.

Defined cases: a null text has size 8 and CRC 0, null source or language sorts first, rows that are equal in all of id and text
are interchangeable and, as no range can part them, read by one task, a few longs each; of a very long text only hashes are moved;
an empty table gives an empty result, and other columns are ignored or, in `write`, carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamtable.llm.common import stage, whole, work_dir

SHARDS = 24
BITS = 5
DIMENSIONS = ("source", "lang")
#: Values of a dimension that are broadcast.
BROADCAST_VALUES = 100_000


def curve(spark: SparkSession) -> DataFrame:
    """(cell, place) for all 2**(3*BITS) cells of the cube, made by rule: Skilling's transform from axes to the curve's place."""
    side = 1 << BITS
    x = [f"cast(id div {side * side} AS int)", f"cast(id div {side} % {side} AS int)", f"cast(id % {side} AS int)"]
    df = spark.range(side**3).selectExpr("cast(id AS int) AS cell", *(f"{e} AS x{k}" for k, e in enumerate(x)))
    for axes in _steps():
        df = df.selectExpr("cell", *(f"{e} AS x{k}" for k, e in enumerate(axes)))
    return df.selectExpr("cell", f"{_interleave()} AS place")


def _steps(xor=lambda a, b: f"(({a}) ^ ({b}))"):
    """The transform as a list of assignments to x0, x1, x2, in terms of those before. xor: how the engine writes it."""
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for k in range(3):
            swap = f"({xor('x0', f'x{k}')} & {p})"
            own = f"CASE WHEN (x{k} & {q}) <> 0 THEN x{k} ELSE {xor(f'x{k}', swap)} END"
            first = f"CASE WHEN (x{k} & {q}) <> 0 THEN {xor('x0', p)} ELSE {xor('x0', swap)} END"
            yield [first if a == 0 else own if a == k else f"x{a}" for a in range(3)]
        q >>= 1
    yield ["x0", xor("x1", "x0"), "x2"]
    yield ["x0", "x1", xor("x2", "x1")]
    turn = "0"
    q = 1 << (BITS - 1)
    while q > 1:
        turn = xor(turn, f"CASE WHEN (x2 & {q}) <> 0 THEN {q - 1} ELSE 0 END")
        q >>= 1
    yield [xor(f"x{k}", turn) for k in range(3)]


def _interleave() -> str:
    return " + ".join(f"((x{k} >> {b}) & 1) * {1 << (3 * b + 2 - k)}" for b in range(BITS) for k in range(3))


def narrow(docs: DataFrame, path: str) -> DataFrame:
    """What ordering needs, staged, so that the text is read once."""
    text = whole(F.col("text"))
    return stage(
        docs.select(
            "doc_id", *DIMENSIONS, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            _number(F.md5(text)).alias("text_hash"), _number(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("id_hash"),
        ),
        path,
    )


def _number(md5: Column) -> Column:
    """A hash's first 60 bits as a long, which sorts as its hex digits do."""
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def quantised(rows: DataFrame, root: str) -> DataFrame:
    """rows with q_<dimension> in 0 .. 2**BITS - 1: values in order, as many rows to each number as values allow."""
    side = 1 << BITS
    for name in DIMENSIONS:
        values = rows.groupBy(F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        place = F.coalesce(F.sum("_n").over(before), F.lit(0))
        values = values.select("_v", place.alias("_b"), F.sum("_n").over(everywhere).alias("_t"))
        values = values.select("_v", F.expr(f"cast({side} * _b div _t AS int)").alias(f"q_{name}"))
        values = stage(values.select("_v", f"q_{name}"), f"{root}/values-{name}")
        # Broadcast only where few values are; else the join is the planner's.
        values = F.broadcast(values) if values.count() <= BROADCAST_VALUES else values
        rows = rows.join(values, F.col(name).eqNullSafe(F.col("_v")), "left").drop("_v")
    return rows.withColumn("q_size", F.least(F.length(F.bin("size")), F.lit(side - 1)))


def ordered(docs: DataFrame, root: str) -> DataFrame:
    """narrow() rows with `place` on the curve and `rank`, the row's number in the whole order from 0, and `total`."""
    spark, side = docs.sparkSession, 1 << BITS
    rows = quantised(narrow(docs, f"{root}/narrow"), root)
    rows = rows.withColumn("cell", F.col("q_source") * side * side + F.col("q_lang") * side + F.col("q_size"))
    # 32,768 rows of two ints, whatever the input.
    rows = rows.join(F.broadcast(curve(spark)), "cell").drop("cell", "q_source", "q_lang", "q_size")
    keys = ["place", "text_hash", "id_hash", "doc_id"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    rows = stage(rows, f"{root}/ordered")
    part = F.shiftright("at", 33)
    parts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(everywhere).alias("total"))
    # One row for each shuffle partition.
    rows = rows.withColumn("part", part).join(F.broadcast(parts), "part")
    return rows.withColumn("rank", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first", "at")


def shards(docs: DataFrame, n: int = SHARDS, root: str | None = None) -> DataFrame:
    """ordered() rows with shard and slot."""
    rows = ordered(docs, root or work_dir(docs.sparkSession, "hilbert"))
    rows = rows.withColumn("shard", F.expr(f"cast(({n} * (rank + 1) - 1) div total AS int)"))
    return rows.withColumn("slot", F.expr(f"rank - cast(shard AS bigint) * total div {n}"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; place besides."""
    return shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")


def write(docs: DataFrame, path: str, n: int = SHARDS) -> None:
    """The documents with all their columns as n shard folders of Parquet files, in the curve's order."""
    own = shards(docs, n).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "place", "shard", "slot")
    # Rows of one id and text are interchangeable: number them on both sides.
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    own = own.withColumn("_nth", nth("_id", "_hash"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), _number(F.md5(whole(F.col("text")))).alias("_hash2"))
    packed = packed.withColumn("_nth2", nth("d.doc_id", "_hash2"))
    both = packed.join(own, F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_hash2")) & (F.col("_nth") == F.col("_nth2")))
    rows = both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("d.*", F.col("shard").alias("shard_id"))
    rows.write.mode("overwrite").partitionBy("shard_id").parquet(path)


def oracle() -> str:
    """The same in DuckDB's SQL, which has no CRC: it is folded over the text's bytes with a table made by rule."""
    side = 1 << BITS
    table = "SELECT n, n AS c FROM (SELECT unnest(range(256)) AS n)"
    for _ in range(8):
        table = f"SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END AS c FROM ({table})"
    cells = f"SELECT id::INT AS cell, (id // {side * side})::INT AS x0, (id // {side} % {side})::INT AS x1, (id % {side})::INT AS x2 FROM (SELECT unnest(range({side**3})) AS id)"
    for axes in _steps(lambda a, b: f"xor({a}, {b})"):
        cells = f"SELECT cell, {', '.join(f'{e} AS x{k}' for k, e in enumerate(axes))} FROM ({cells})"
    q = lambda name: f"(SELECT {name} AS v, {side} * coalesce(sum(count(*)) OVER (ORDER BY {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // sum(count(*)) OVER () AS q FROM d GROUP BY {name})"
    return rf"""
WITH tab AS (SELECT list(c ORDER BY n) AS tab FROM ({table})),
d AS (SELECT doc_id, source, lang, strlen(coalesce(text, ''))::BIGINT + 8 AS size, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)::BIGINT AS text_crc32 FROM d, tab),
p AS (SELECT cell, {_interleave()} AS place FROM ({cells})),
o AS (SELECT c.*, p.place, row_number() OVER (ORDER BY p.place, md5(t), md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank, count(*) OVER () AS total
  FROM c JOIN {q('source')} s ON c.source IS NOT DISTINCT FROM s.v JOIN {q('lang')} l ON c.lang IS NOT DISTINCT FROM l.v
  JOIN p ON p.cell = s.q * {side * side} + l.q * {side} + least(length(bin(size)), {side - 1}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (({SHARDS} * (rank + 1) - 1) // total)::INT AS shard,
  rank - (({SHARDS} * (rank + 1) - 1) // total) * total // {SHARDS} AS slot, NULL::INT AS grown_shard, place::INT AS place
FROM o"""

