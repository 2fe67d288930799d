"""Joins and window frames that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, time: str, by: list[str] | str = (), columns: list[str] | None = None, strict: bool = False, ranges: int = 1) -> DataFrame:
    """Each left row with the columns of the last right row of the same `by` at or before its time (strict: before).

    Both sides are put together and sorted once by key and time, and the last right row seen is carried on: one shuffle, and no
    pairs. Nulls in the key match each other. Without such a row the right columns are null; of right rows at one time the one
    with the largest columns counts. A left row's own columns keep their names, so right ones must differ.

    A key's rows go to one task. Where few keys hold most rows, or there is no key, cut time into `ranges` of about as many right
    rows: tasks then take a key's range each, and the last right row before a range comes from one row for each key and range.
    """
    by = [by] if isinstance(by, str) else list(by)
    columns = columns or [c for c in right.columns if c not in (*by, time)]
    packed_left = left.select(*by, F.col(time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_found"))
    packed_right = right.select(*by, F.col(time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(packed_left.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_found"))
    cuts = _cuts(right, time, ranges)
    part = F.lit(0)
    for cut in cuts:
        part = part + F.when(F.col("_t") > F.lit(cut), 1).otherwise(0)
    both = packed_left.unionByName(packed_right).withColumn("_range", part)
    order = Window.partitionBy(*by, "_range").orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_found").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_found", ignorenulls=True).over(order)).where(F.col("_row").isNotNull())
    if cuts:
        # At most `ranges` rows a key, from partial aggregates.
        grid = both.groupBy(*by, "_range").agg(F.max(F.when(F.col("_found").isNotNull(), F.struct("_t", "_found"))).alias("_end"))
        before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        grid = grid.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(by)), F.col("_range").alias("_r"), F.last("_end._found", ignorenulls=True).over(before).alias("_before"))
        on = F.col("_range") == F.col("_r")
        for k, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"_k{k}"))
        seen = seen.join(grid, on, "left").withColumn("_last", F.coalesce("_last", "_before"))
    return seen.select("_row.*", *(F.col(f"_last.{c}").alias(c) for c in columns))


def _cuts(right: DataFrame, time: str, ranges: int) -> list:
    """Times that cut the right rows into about equal ranges."""
    if ranges < 2:
        return []
    found = right.agg(F.percentile_approx(time, [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(found or []))


def range_join(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Left rows with the right rows whose [start, end) holds their point.

    An interval is dealt out to each bucket of `width` that it meets and the rows meet on the bucket, an equi-join; take the
    usual length of an interval. Points and bounds are numbers.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    last = F.greatest(bucket(start), F.ceil(F.col(end) / width).cast("long") - 1)
    spread = right.where(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(bucket(start), last)))
    both = left.withColumn("_bucket", bucket(point)).join(spread, "_bucket")
    return both.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")


def over_groups(df: DataFrame, aggregate: Column, name: str, partition: list[str], order: list[Column], preceding: int, following: int) -> DataFrame:
    """df with an aggregate over a GROUPS frame: so many groups of peers before and after the row's own."""
    ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("_group").rangeBetween(-preceding, following)
    return ranked.withColumn(name, aggregate.over(frame)).drop("_group")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join with hot keys on the left: left rows of a key go to `salts` tasks, and the right side is dealt out to all of them.

    For joins that keep left rows (inner, left, left_semi, left_anti); the right side must be the smaller one.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join can't be salted on its left side")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, [*on, "_salt"], how).drop("_salt")
