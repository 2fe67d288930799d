"""Streams over topics: windows of time, sessions, and joins of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtable.sources.store import Store


def with_watermark(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Rows that come later than `late` behind the newest time are left out of windows that are closed."""
    return stream.withWatermark(time, late)


def windowed(df: DataFrame, time: str, width: str, aggregates: dict[str, Column], keys: list[str] = (), slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones with `slide`: window_start, window_end, keys and aggregates. For streams and batches alike."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.groupBy(window, *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, aggregates: dict[str, Column], keys: list[str]) -> DataFrame:
    """Runs of rows of a key with no gap as long as `gap`."""
    out = df.groupBy(F.session_window(time, gap), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggregates)


def stream_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Rows of two streams with equal keys and times no further apart than `within`; state older than that is let go.

    Keys come once, then the left's other columns, then the right's; those whose names the left has too begin with `right_`.
    """
    a = left.withWatermark(left_time, late).alias("l")
    b = right.withWatermark(right_time, late).alias("r")
    near = F.expr(f"r.`{right_time}` BETWEEN l.`{left_time}` - INTERVAL {within} AND l.`{left_time}` + INTERVAL {within}")
    on = near
    for k in keys:
        on = on & (F.col(f"l.`{k}`") == F.col(f"r.`{k}`"))
    rest = [c for c in right.columns if c not in keys]
    own = [F.col(f"r.`{c}`").alias(f"right_{c}" if c in left.columns else c) for c in rest]
    return a.join(b, on).select(*(F.col(f"l.`{c}`") for c in left.columns), *own)


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there into an in-memory table and return it; for tests and small results, as rows are kept on the driver."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(table)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there into Parquet files, exactly once, and read them."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there in complete mode, and read the whole result from Parquet files; no row of it goes to the driver.

    Each batch writes a folder of its number, in place of what a failed run may have left there; the result before stays for those
    who read it now, and older ones or another checkpoint's are removed.
    """
    store = Store(stream.sparkSession, path)

    def batch(df: DataFrame, number: int) -> None:
        kept = [f"{k:020d}" for k in (number - 1, number)]
        df.write.mode("overwrite").parquet(store.path(kept[-1]))
        for name in set(store.names(store.root)) - set(kept):
            store.delete(store.path(name))

    stream.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = store.names(store.root)
    read = stream.sparkSession.read.schema(stream.schema)
    return read.parquet(store.path(found[-1])) if found else stream.sparkSession.createDataFrame([], stream.schema)
