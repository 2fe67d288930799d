"""Small documents with the cases that every operator must handle."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LINE = "This line is shared by many documents."
LONG = " ".join(f"word{k % 977} w{k}" for k in range(60_000))

ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t \x0b\x0c\r\n", "en", "a", 7),
    (4, f"one two three\n{LINE}\n\nfour", "en", "b", None),
    (5, f"  {LINE.upper()}  \nfive six", "en", "b", None),
    (6, f"{LINE}\n{LINE}\nseven é ü", "de", "c", None),
    (7, "same text here", "en", "a", 14),
    (8, "same text here", "en", "a", 14),
    (8, "same text here", "en", "a", 14),
    (9, "a b c a b c a b c", "en", "d", 17),
    (10, LONG, "en", "d", len(LONG)),
    (None, "no id here at all", "en", "d", 17),
    (11, "漢字 かな \U0001f600 <|endoftext|> don't 123", "ja", "é", None),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """With columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("size", "fp", "rank", "places", "kept", "w", "d", "key", "target", "_id", "length", "score"):
        df = df.withColumn(name, F.lit("x"))
    return df


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))
