"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table of (h1, h2, n_docs, keeper): the 128-bit hash of a line's key, the documents of one batch that hold it
and the largest id among them, bucketed and sorted by the hash, with every key in one run only. Each new batch is
merge-anti-joined with the runs, whose side of the join needs no exchange. Its keys that no run has are fresh and make a run of
their own at level 0; what is left of the batch are repeats. Before a batch, a level that holds `fanout` runs is merged into one
run of the next level, so a key is rewritten once a level and a batch meets few runs. All of it is DataFrame operations.

Documents come in batches of falling ids. So a key's document with the largest id is in the batch in which the key is fresh, and
is the largest there; all its other documents are repeats, and what decides which lines go is the number of repeats. Only keys
with repeats are counted over the batches and joined with the lines again, with salts for hot lines, the keys that many
documents hold.

Keys: a line with ASCII white space stripped at both ends and A-Z lower-cased. Lines with keys under `min_chars` code points are
never dropped.

Defined cases: a null or empty text is one empty line, which stays; rows with one id are one document when lines are counted;
null ids sort below all others and count as one document; equal rows give equal rows; of a very long text only hashes are shuffled
line by line, and the text itself is held as one array of lines; an empty table gives an empty result; columns beyond the id and
the text are carried or ignored under their own names and can't clash.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtable.llm.common import SPACE, ascii_lower, stage, whole, work_dir

MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 2
BATCHES = 4
#: Salts of the join that marks the lines of repeated keys.
SALTS = 16


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def falling(docs: DataFrame, batches: int) -> Column:
    """The batch of a document: equal shares of the rows by falling id, from approximate quantiles; null ids are in the last."""
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 1000)).first()[0] if shares else None
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + F.when(F.col("doc_id").cast("long") > cut, 0).otherwise(1)
    return batch


def line_table(docs: DataFrame, batch: Column | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line with a long enough key: the document's id and text hash, the line's place, its key's hashes, its batch."""
    text = whole(F.col("text"))
    lines = docs.select("doc_id", (F.lit(0) if batch is None else batch).alias("batch"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "batch", "text_hash", "pos", F.btrim("line", F.lit(SPACE)).alias("k")).where(F.length("k") >= min_chars)
    key = ascii_lower(F.col("k"))
    return keys.select("doc_id", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), "batch")


class LineRuns:
    """The state: levels of sorted runs below a shared folder."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.root, self.fanout = spark, root, fanout
        # As many as a shuffle has partitions, so that a join's other side is dealt out like its runs.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._made, self._name = 0, f"spark_catalog.default.line_runs_{uuid.uuid4().hex}"

    def runs(self) -> list[DataFrame]:
        """The runs; no key is in two of them."""
        return [self.spark.table(name) for level in self.levels for name in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (one for each h1, h2) that no run has."""
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def ingest(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add a batch, a line_table() of documents that no other batch holds. Returns its fresh keys, as (h1, h2, n_docs, keeper),
        and its repeats: (h1, h2, n_repeats, keeper), with the documents beyond a key's first one. There a fresh key has its
        largest id as keeper, and a key of an earlier batch has first = false.
        """
        once = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        keys = once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        self._compact()
        before, path = bool(self.runs()), f"{self.root}/batches/{self._made:06d}"
        if before:
            keys = stage(keys, f"{path}-keys")
        fresh = self._add(self.fresh(keys), 0)
        repeats = fresh.where("n_docs > 1").select("h1", "h2", (F.col("n_docs") - 1).alias("n_repeats"), "keeper", F.lit(True).alias("first"))
        if before:
            known = keys.join(fresh.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            repeats = repeats.unionByName(known.select("h1", "h2", F.col("n_docs").alias("n_repeats"), "keeper", F.lit(False).alias("first")))
        return fresh, stage(repeats, f"{path}-repeats")

    def _add(self, keys: DataFrame, level: int) -> DataFrame:
        name = f"{self._name}_{self._made}"
        # Dealt out as the buckets are, so that each has one file.
        out = keys.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        out.option("path", f"{self.root}/level-{level}/run-{self._made:06d}").saveAsTable(name)
        atexit.register(_drop, self.spark, name)
        self._made += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                names, self.levels[level] = self.levels[level], []
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self._add(merged, level + 1)
                for name in names:
                    _drop(self.spark, name)
            level += 1


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended first, and its catalog with it
        pass


def survivors(lines: DataFrame, state: LineRuns) -> DataFrame:
    """For a stream of batches: the batch's lines that no earlier batch had. Ingests the batch; within it the largest id keeps."""
    fresh, _ = state.ingest(lines)
    return lines.join(fresh.select("h1", "h2", "keeper"), ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("keeper"))).drop("keeper")


def dropped_places(docs: DataFrame, root: str, batches: int = BATCHES, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The places of the lines to drop, as one array for each (doc_id, text_hash) that has any."""
    spark = docs.sparkSession
    lines = stage(line_table(docs, falling(docs, batches), min_chars), f"{root}/lines", "batch")
    state = LineRuns(spark, f"{root}/runs")
    repeats = None
    for k in range(batches):
        of_batch = state.ingest(lines.where(F.col("batch") == k))[1].withColumn("batch", F.lit(k))
        repeats = of_batch if repeats is None else repeats.unionByName(of_batch)
    hot = repeats.groupBy("h1", "h2").agg(F.sum("n_repeats").alias("n")).where(F.col("n") >= min_docs - 1).select("h1", "h2")
    # A batch's rows of a hot key are dealt out by their salt; the other side has one row for each key and batch.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hot = stage(repeats.join(hot, ["h1", "h2"]).select("batch", "h1", "h2", "first", "keeper"), f"{root}/hot").select("*", salts)
    own = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    found = own.join(hot, ["batch", "h1", "h2", "salt"]).where(~(F.col("first") & F.col("doc_id").eqNullSafe(F.col("keeper"))))
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("places"))


def dedup(docs: DataFrame, root: str | None = None, **limits: int) -> DataFrame:
    """docs with `lines`, `places` (of the dropped lines, or null) and `kept` (the text without them) added as one struct `dedup`."""
    root = root or work_dir(docs.sparkSession, "line-dedup")
    places = dropped_places(docs, root, **limits)
    right = places.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("places").alias("_places"))
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    both = left.join(right, F.col("d.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(whole(F.col("d.text"))) == F.col("_hash")), "left")
    both = both.select("d", "_places", F.split(whole(F.col("d.text")), "\n", -1).alias("_lines"))
    # Set difference by hashing keeps the order of the first array.
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_places"))
    both = both.select("d", "_places", "_lines", F.when(F.col("_places").isNotNull(), stays).alias("_stays"))
    rest = F.array_join(F.transform("_stays", lambda i: F.get("_lines", i)), "\n")
    kept = F.when(F.col("_places").isNull(), whole(F.col("d.text"))).otherwise(rest)
    n = F.size("_lines").cast("long").alias("n_lines")
    n_dropped = F.coalesce(F.when(F.col("_places").isNotNull(), F.size("_places")), F.lit(0)).cast("long").alias("n_dropped")
    return both.select("d", n, n_dropped, kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup(docs).select("d.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with the lines dropped from `text` and n_chars renewed where any are; such rows go if only white space stays of them."""
    out = dedup(docs)
    changed = lambda c, value: F.when(F.col("n_dropped") > 0, value).otherwise(F.col(f"d.{c}"))
    new = {"text": changed("text", F.col("kept")), "n_chars": changed("n_chars", F.length("kept").cast("long"))}
    new = {c: v for c, v in new.items() if c in docs.columns}
    own = out.select("n_dropped", *(new[c].alias(c) if c in new else F.col(f"d.`{c}`").alias(c) for c in docs.columns))
    return own.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("n_dropped")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    chars = r" ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) ".strip()
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {chars}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM u),
h AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= {MIN_DOCS}),
f AS (SELECT k.*, h.k IS NOT NULL AND k.doc_id IS DISTINCT FROM h.keeper AS gone FROM k LEFT JOIN h ON k.k = h.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id"""
