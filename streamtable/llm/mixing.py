"""Mixing sources to target weights by capped water-filling.

The words of all sources are shared out by weight; a source is clamped at `max_epochs` times its own size, and what it can't
take is reshared among the others by weight until none is above its cap. Sorted by cap over weight, the clamped sources are a
prefix of the list, so the fixed point is found with running sums over one row for each source.

A source's target over its size is its number of epochs: every document is repeated by the whole part, and a seeded part of
the documents once more. That part is cut from the documents in the order of a hash of seed and id, at the place where the
words come nearest to the target. The place is found in two histograms over the hash, so that no task sorts a source, however
large, and reruns agree.

Defined cases: a null text has size 0; null is a source of its own, last in order; a source of size 0 has target 0 and takes
nothing; documents of size 0 are taken with the others by their hash and add no words; equal ids are drawn together, and so are ids
with one draw of 24 bits; of a very long text only the number of its words is kept, so a source with such a text may miss its target
by half of it; an empty table gives an empty result; other columns are carried by `mix` under their own names and can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamtable.llm.common import n_words, stage, work_dir

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the hash in each of the two histograms: 4096 bins a source.
DIGITS = 3


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size), one row a source, adds weight and target. Weights repeat over the sources in order."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), place + 1)
    t = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    ratio = F.col("cap") / F.col("weight")
    by_ratio = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())
    before, onwards = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("left", F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("level", F.col("left") / F.sum("weight").over(onwards))
    # The level of the first source that stays under its cap holds for it and all that follow.
    t = t.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(ratio, F.col("source").isNull(), "source", "level"))).over(everywhere)["level"])
    return t.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def draws(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, size, draw), staged: the text is read once."""
    draw = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 2 * DIGITS)
    return stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw.alias("draw")), path)


def plan(drawn: DataFrame, path: str, **rules) -> DataFrame:
    """For each source: size, target, whole repetitions, and the last draw that is taken once more (null: none), staged."""
    bins = drawn.groupBy("source", F.substring("draw", 1, DIGITS).alias("high")).agg(F.sum("size").alias("words"))
    bins = stage(bins, f"{path}/bins")
    sources = targets(bins.groupBy("source").agg(F.sum("words").alias("source_size")), **rules)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = stage(sources, f"{path}/sources")

    def cut(table: DataFrame, key: str) -> DataFrame:
        """Adds to each bin the words before it."""
        w = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))

    s = sources.select(F.col("source").alias("_s"), "rest")
    edge = cut(bins, "high").join(s, F.col("source").eqNullSafe(F.col("_s")))
    edge = edge.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))).select("_s", F.col("high").alias("_h"), F.col("before").alias("start"), "rest")
    fine = drawn.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.substring("draw", 1, DIGITS) == F.col("_h")))
    fine = fine.groupBy("source", "draw", "start", "rest").agg(F.sum("size").alias("words"))
    fine = cut(fine, "draw").select("source", "draw", "rest", (F.col("before") + F.col("start")).alias("from"), (F.col("before") + F.col("start") + F.col("words")).alias("to"))
    # The bins that end below the target, and the one that crosses it if that comes nearer.
    near = fine.where((F.col("to") <= F.col("rest")) | (F.col("from") <= F.col("rest")) & (F.col("to") - F.col("rest") < F.col("rest") - F.col("from")))
    last = near.groupBy(F.col("source").alias("_s")).agg(F.max("draw").alias("last"))
    first = edge.select(F.col("_s").alias("_e"), F.concat("_h", F.lit("")).alias("_h"))
    out = sources.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").join(first, F.col("source").eqNullSafe(F.col("_e")), "left")
    # Without any draw in the edge bin, all bins below it; draws sort as text, and "" comes before the bin's first draw.
    return stage(out.select("source", "source_size", "weight", "target", "whole", F.when(F.col("rest") > 0, F.coalesce("last", "_h")).alias("last")), f"{path}/plan")


def copies(drawn: DataFrame, mix_plan: DataFrame) -> DataFrame:
    """drawn with source_size, target and n_copies. The plan is one row a source."""
    p = mix_plan.select(F.col("source").alias("_s"), "source_size", "target", "whole", "last")
    more = F.coalesce(F.col("draw") <= F.col("last"), F.lit(False)).cast("long")
    both = drawn.join(p, F.col("source").eqNullSafe(F.col("_s")), "left")
    return both.withColumn("n_copies", F.coalesce(F.col("whole"), F.lit(0)) + more).drop("_s", "whole", "last")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; n_copies and source besides."""
    root = work_dir(docs.sparkSession, "mixing")
    drawn = draws(docs, f"{root}/draws")
    out = copies(drawn, plan(drawn, root))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies", "source")


def mix(docs: DataFrame, **rules) -> DataFrame:
    """The mixed corpus: each document's row as often as it is taken."""
    root = work_dir(docs.sparkSession, "mixing")
    p = plan(draws(docs, f"{root}/draws"), root, **rules)
    draw = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 2 * DIGITS)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("source"), draw.alias("draw"))
    out = copies(packed, p).where("n_copies > 0").select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
    return out.select("d.*")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{word}'))::BIGINT AS size,
  substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {2 * DIGITS}) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, {MAX_EPOCHS} * source_size AS cap FROM s),
r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT level FROM r WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f) * weight, cap::DOUBLE)) AS target FROM r),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT *, target - whole * source_size AS rest FROM e),
b AS (SELECT source, draw, sum(size) AS words FROM d GROUP BY source, draw),
c AS (SELECT source, draw, words, sum(words) OVER (PARTITION BY source ORDER BY draw) AS upto FROM b),
n AS (SELECT c.source, max(c.draw) AS last FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source WHERE x.rest > 0 AND (upto <= rest OR upto - words <= rest AND upto - rest < rest - (upto - words)) GROUP BY c.source)
SELECT doc_id, size, source_size, target, (size * n_copies)::BIGINT AS taken, n_copies, source
FROM (SELECT d.doc_id, d.size, x.source_size, x.target, (x.whole + CASE WHEN d.draw <= n.last THEN 1 ELSE 0 END)::BIGINT AS n_copies, d.source
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source LEFT JOIN n ON d.source IS NOT DISTINCT FROM n.source)"""
