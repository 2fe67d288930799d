"""What the corpus operators share: work folders, staged tables and the ASCII word rules."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as characters to trim and as a regular expression.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: the session's checkpoint folder. In local mode alone, a temporary one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="streamtable-"))
    return root.rstrip("/")


_local: dict[str, str] = {}
_made: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of an operator, removed when the driver ends or by clear_work()."""
    path = f"{work_root(spark)}/streamtable/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    atexit.register(_remove, spark, path)
    return path


def clear_work(spark: SparkSession) -> int:
    """Remove the work folders made so far, for long sessions. DataFrames that operators gave before are void then."""
    paths = list(_made)
    _made.clear()
    for path in paths:
        _remove(spark, path)
    return len(paths)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM has gone first
        pass


def stage(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write df as a Parquet table and read it again: lineage ends here, and a lost executor costs nothing before it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(_nullable(df)).parquet(path)


def _nullable(df: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


#: Bits of a sieve: so many for each key, and so many at most. A sieve with too few bits lets more rows through, never fewer.
SIEVE_BITS, MOST_SIEVE_BITS = 16, 1 << 27
#: Bits in one of Spark's bitmaps.
BITMAP_BITS = 1 << 15


def sieved(df: DataFrame, hash: Column, keys: DataFrame, key_hash: Column, path: str) -> DataFrame:
    """df with `_maybe`, true for each row whose hash a row of keys has and for few others, so that a join need not move the rest.

    keys: a staged table. Its hashes set bits of bitmaps that are broadcast, 16 MB at most whatever the input. Hashes aren't null.
    """
    bits = BITMAP_BITS
    while bits < min(MOST_SIEVE_BITS, SIEVE_BITS * keys.count()):
        bits *= 2
    place = lambda h: h.bitwiseAND(F.lit(bits - 1))
    part = lambda h: F.shiftright(place(h), 15)
    within = lambda h: h.bitwiseAND(F.lit(BITMAP_BITS - 1))
    maps = stage(keys.groupBy(part(key_hash).alias("_part")).agg(F.bitmap_construct_agg(within(key_hash)).alias("_map")), path)
    byte = F.substr(F.col("_map"), (F.shiftright(within(hash), 3) + 1).cast("int"), F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), hash.bitwiseAND(F.lit(7)).cast("int")) == 1
    found = df.join(F.broadcast(maps), part(hash) == F.col("_part"), "left")
    return found.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(bit, F.lit(False)).alias("_maybe"))


def whole(text: Column) -> Column:
    """The text, where null is empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty where there are none."""
    return F.array_remove(F.split(whole(text), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, with this package sent to the executors first, once an application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="streamtable-code-")
        with zipfile.ZipFile(path := os.path.join(folder, f"{package.name}.zip"), "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)
