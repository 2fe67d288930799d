"""Token ids in files of a static range asymmetric numeral system.

All blocks share one frequency table over the vocabulary, counted over every id of the corpus and scaled to 2**20. A block holds
whole documents in ascending order of id. Its ids are cut into segments, each coded on its own: ids are dealt to interleaved
lanes, numpy steps through all lanes at once, and a lane's 64-bit state gives off 32-bit words. A segment keeps the lanes' states
every CHECKPOINT steps with the place in the words, so decoding can start there, as `lookup` does, and a CRC-32 of its ids. Blocks are rows of a
Parquet table, so that any store that Spark can write holds the files, and writing survives lost executors; block and segment
are independent, so decoding is as parallel as blocks.

Ids are staged as 16-bit numbers once. Only the frequency table, one number for each entry of the vocabulary, goes to the driver.

Defined cases: a null or empty text is the end id alone; a very long text is a block of its own of several segments; null ids sort first; rows with one id are ordered by their ids' bytes;
an empty table gives empty files and an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamtable.llm.common import map_arrow, work_dir
from streamtable.llm.tokens import END_ID, Encoder, default_vocabulary, slices

SCALE_BITS = 20
LOWEST = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
LANES = 512
SEGMENT = 1 << 18
CHECKPOINT = 128
#: Documents are gathered into a block until it has so many ids; a longer document is a block of several segments.
BLOCK = 1 << 18
MAGIC = b"STRA"
_HEAD = struct.Struct("<4sIII")  # magic, documents, ids, segments
_SEGMENT = struct.Struct("<IIIIII")  # ids, lanes, words, checkpoints, CRC of the ids, pad symbol


class Table:
    """A scaled frequency table with what coding looks up."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64))
        self.pad = int(freq.argmax())

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> "Table":
        """Every id that occurs gets 1 at least; what rounding leaves goes to or comes from the most frequent ids."""
        scale, total = 1 << SCALE_BITS, int(counts.sum())
        freq = np.where(counts > 0, np.maximum(1, counts * scale // max(total, 1)), 0).astype(np.int64)
        if not total:
            freq[END_ID] = scale
        over = int(freq.sum()) - scale
        for k in np.argsort(-freq, kind="stable"):
            if not over:
                break
            step = min(over, int(freq[k]) - 1) if over > 0 else over
            freq[k] -= step
            over -= step
        return cls(freq)


def encode_segment(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = LANES if n >= 64 * LANES else max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, table.pad, ids.dtype)
    padded[:n] = ids
    rows = padded.reshape(steps, lanes)
    freq, low = table.freq[rows], table.low[rows]
    most = freq << np.uint64(63 - SCALE_BITS)
    x = np.full(lanes, LOWEST, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []  # steps from the front, states before that step is decoded
    for t in range(steps - 1, -1, -1):
        f = freq[t]
        spill = x >= most[t]
        words.append(x[spill].astype(np.uint32))
        x = np.where(spill, x >> WORD_BITS, x)
        q = x // f
        x = (q << np.uint64(SCALE_BITS)) + (x - q * f) + low[t]
        if t and t % CHECKPOINT == 0:
            marks.append((t, x))
    words.reverse()
    sizes = np.cumsum([0, *map(len, words)])
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    out = [_SEGMENT.pack(n, lanes, len(flat), len(marks), zlib.crc32(ids.astype("<u4").tobytes()), table.pad), x.astype("<u8").tobytes()]
    for t, state in reversed(marks):
        out += [struct.pack("<II", t, int(sizes[t])), state.astype("<u8").tobytes()]
    return b"".join([*out, flat.astype("<u4").tobytes()])


def segment_bytes(data: memoryview) -> tuple[int, int]:
    """The number of ids of a segment and its bytes."""
    n, lanes, n_words, n_marks, *_ = _SEGMENT.unpack_from(data)
    return n, _SEGMENT.size + 8 * lanes + n_marks * (8 + 8 * lanes) + 4 * n_words


def decode_range(data: memoryview, table: Table, start: int, stop: int) -> np.ndarray:
    """The segment's ids from start to stop, decoded from the last checkpoint before start. Its checksum isn't looked at."""
    n, lanes, *_ = _SEGMENT.unpack_from(data)
    checkpoint = start // lanes // CHECKPOINT
    ids, _ = decode_segment(data, table, checkpoint, -(-min(stop, n) // lanes))
    skipped = checkpoint * CHECKPOINT * lanes
    return ids[start - skipped : stop - skipped]


def decode_segment(data: memoryview, table: Table, checkpoint: int = 0, last_step: int | None = None) -> tuple[np.ndarray, int]:
    """The segment's ids, from its k-th checkpoint on (0: its start), and its bytes. A wrong checksum of all ids raises ValueError."""
    n, lanes, n_words, n_marks, crc, _ = _SEGMENT.unpack_from(data)
    at = _SEGMENT.size
    first, word = 0, 0
    for k in range(n_marks + 1):
        if k:
            t, w = struct.unpack_from("<II", data, at)
            at += 8
        if k == checkpoint:
            x = np.frombuffer(data, "<u8", lanes, at).astype(np.uint64)
            first, word = (t, w) if k else (0, 0)
        at += 8 * lanes
    words = np.frombuffer(data, "<u4", n_words, at).astype(np.uint64)
    whole = -(-n // lanes)
    steps = whole if last_step is None else last_step
    out = np.empty((steps - first, lanes), np.uint16)
    mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for t in range(steps - first):
        slot = x & mask
        s = table.symbol[slot]
        out[t] = s
        x = table.freq[s] * (x >> shift) + slot - table.low[s]
        need = np.flatnonzero(x < LOWEST)
        if len(need):
            x[need] = (x[need] << WORD_BITS) | words[word : word + len(need)]
            word += len(need)
    ids = out.reshape(-1)[: n - first * lanes]
    if not checkpoint and steps == whole and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a segment's checksum is wrong")
    return ids, at + 4 * n_words


def encode_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    parts = [encode_segment(ids[k : k + SEGMENT], table) for k in range(0, len(ids), SEGMENT)]
    known = np.array([x is not None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], "<i8")
    body = b"".join([_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(parts)), known.tobytes(), keys.tobytes(), sizes.astype("<u4").tobytes(), *parts])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_documents(data: bytes, table: Table, wanted: set[int]) -> list[tuple[int, np.ndarray]]:
    """(doc_id, ids) of the wanted documents of a block. Only what lies between a document's checkpoints and its end is decoded."""
    body = memoryview(data)[:-4]
    magic, n_docs, n_ids, n_parts = _HEAD.unpack_from(body)
    if magic != MAGIC or zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a block, or its checksum is wrong")
    at = _HEAD.size
    known = np.frombuffer(body, np.uint8, n_docs, at)
    keys = np.frombuffer(body, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(body, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    segments = []  # first id, ids, place
    first = 0
    for _ in range(n_parts):
        n, size = segment_bytes(body[at:])
        segments.append((first, n, at))
        first, at = first + n, at + size
    out = []
    starts = np.cumsum(sizes) - sizes
    for k in np.flatnonzero(known.astype(bool) & np.isin(keys, list(wanted))).tolist():
        a, b = int(starts[k]), int(starts[k] + sizes[k])
        out.append((int(keys[k]), np.concatenate([decode_range(body[p:], table, max(a - f, 0), min(b - f, n)) for f, n, p in segments if f < b and a < f + n])))
    return out


def decode_block(data: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of a block."""
    body = memoryview(data)[:-4]
    magic, n_docs, n_ids, n_parts = _HEAD.unpack_from(body)
    if magic != MAGIC or zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a block, or its checksum is wrong")
    at = _HEAD.size
    known = np.frombuffer(body, np.uint8, n_docs, at)
    keys = np.frombuffer(body, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(body, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    parts = []
    for _ in range(n_parts):
        ids, used = decode_segment(body[at:], table)
        parts.append(ids)
        at += used
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    return [k if there else None for k, there in zip(keys.tolist(), known.tolist())], sizes, ids


def token_table(docs: DataFrame, path: str, vocabulary: str | None = None) -> DataFrame:
    """Staged rows (doc_id, ids as 16-bit numbers, kind `ids`), and one row a task of kind `counts`: its ids' counts."""
    name = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(name)
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = encoder.encode(part.column("text"))
                counts += np.bincount(ids, minlength=1 << 16)
                data = ids.astype("<u2").tobytes()
                bounds = (2 * starts).tolist()
                rows = [data[a:b] for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.binary()), pa.array(["ids"] * len(rows))], names=["doc_id", "ids", "kind"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([counts.tobytes()], pa.binary()), pa.array(["counts"])], names=["doc_id", "ids", "kind"])

    rows = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), encode, "doc_id bigint, ids binary, kind string")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["id", "n"])

    rows = map_arrow(tokens.where("kind = 'counts'").select("ids"), flat, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << 16, np.int64)
    for k, n in rows.collect():  # one row for each entry of the vocabulary at most
        counts[k] = n
    return counts


def write(docs: DataFrame, path: str, vocabulary: str | None = None, root: str | None = None) -> None:
    """Write path/blocks and path/table: rows (part, block, first, n_docs, n_ids, low, high, payload) and (id, freq). low and high are
    a block's least and largest document ids, so that looking up documents skips most files.
    """
    spark = docs.sparkSession
    tokens = token_table(docs, f"{root or work_dir(spark, 'rans')}/tokens", vocabulary)
    table = Table.from_counts(count_ids(tokens))
    present = np.flatnonzero(table.freq)
    spark.createDataFrame([(int(k), int(table.freq[k])) for k in present], "id int, freq int").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    freq = table.freq.astype(np.int32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part = Table(freq), TaskContext.get().partitionId()
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        number = first = n = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, first, n
            sizes, ids = np.array([len(x) for x in held], np.int64), np.concatenate(held)
            ends = [k for k in keys if k is not None] or [None]
            row = [part, number, first, len(keys), n, min(ends), max(ends), encode_block(keys, sizes, ids, table)]
            number, first, n = number + 1, first + n, 0
            keys.clear()
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["part", "block", "first", "n_docs", "n_ids", "low", "high", "payload"])

        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                x = np.frombuffer(ids.as_buffer(), "<u2")
                if held and n + len(x) > BLOCK:
                    yield flush()
                keys.append(key)
                held.append(x)
                n += len(x)
        if held:
            yield flush()

    rows = tokens.where("kind = 'ids'").select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    out = map_arrow(rows, blocks, "part int, block int, first bigint, n_docs int, n_ids bigint, low bigint, high bigint, payload binary")
    out.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


def frequencies(spark: SparkSession, path: str) -> np.ndarray:
    """The files' table."""
    freq = np.zeros(1 << 16, np.int32)
    for k, f in spark.read.parquet(f"{path}/table").collect():  # one row for each entry of the vocabulary at most
        freq[k] = f
    return freq


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids as uint32) of a stated list of documents: only blocks that may hold them are read, and only they are decoded."""
    wanted, freq = set(doc_ids), frequencies(spark, path)
    table = spark.createDataFrame([(k,) for k in sorted(wanted)], "k long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Table(freq)
        for batch in batches:
            found = [x for payload in batch.column("payload") for x in decode_documents(payload.as_py(), codes, wanted)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary())], names=["doc_id", "ids"])

    span = F.lit(min(wanted, default=0)), F.lit(max(wanted, default=-1))
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("high") >= span[0]) & (F.col("low") <= span[1]))
    # The caller's list, stated beforehand.
    held = blocks.join(F.broadcast(table), (F.col("k") >= F.col("low")) & (F.col("k") <= F.col("high")), "left_semi")
    return map_arrow(held.select("payload"), decode, "doc_id bigint, ids binary")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids as uint32."""
    freq = frequencies(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for part, first, payload in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist(), batch.column("payload")):
                keys, sizes, ids = decode_block(payload.as_py(), table)
                at = np.cumsum(sizes) - sizes
                wide = ids.astype("<u4")
                data = [wide[a : a + m].tobytes() for a, m in zip(at.tolist(), sizes.tolist())]
                crc = np.fromiter(map(zlib.crc32, data), np.int64, len(data))
                columns = [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(first + at), pa.array(sizes), pa.array(crc)]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(data, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    blocks = spark.read.parquet(f"{path}/blocks")
    # One row for each file's part: the ids before it.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before"))
    kind = "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    rows = map_arrow(blocks.select("part", "first", "payload"), decode, kind)
    rows = rows.join(F.broadcast(parts), F.col("part") == F.col("_p"))
    return rows.select("doc_id", (F.col("ids_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from files written and read back."""
    root = work_dir(docs.sparkSession, "rans")
    write(docs, f"{root}/files", root=root)
    return read(docs.sparkSession, f"{root}/files")
