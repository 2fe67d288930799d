"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of the sequence length and a remainder. Only the histogram of the piece lengths, at most 2048
numbers, goes to the driver. There lengths are placed longest first, each piece into the shortest open pack, the one with the
most room, as counts of packs with one pattern; a pattern's count is split where fewer pieces than packs are left, and a new pack
is opened where the shortest one has no room. The patterns give, for each length, intervals of ranks: the r-th piece of that length has its sequence and place by
arithmetic. Pieces get ranks within their length from counts of a salted split, so that no task holds all pieces of a length.

Defined cases: a null or empty text is the end id alone; equal documents, or repeated rows, are separate documents, each packed
in full; ids may be null; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamtable.llm.common import map_arrow, stage, work_dir
from streamtable.llm.tokens import Encoder, default_vocabulary, slices

SEQUENCE = 2048
#: Parts of the pieces of one length: so many at least, and one for so many pieces.
SALTS, PIECES_A_SALT = 256, 1 << 20
#: More than the pieces of one length.
_RANKS = 1 << 50
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids as little-endian uint32."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = encoder.encode(part.column("text"))
                sizes = np.diff(starts)
                n = -(-sizes // SEQUENCE)
                doc = np.repeat(np.arange(len(sizes)), n)
                start = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * SEQUENCE
                length = np.minimum(SEQUENCE, sizes[doc] - start)
                wide, at = ids.astype("<u4"), starts[doc] + start
                data = [wide[a : a + m].tobytes() for a, m in zip(at.tolist(), length.tolist())]
                crc = np.fromiter(map(zlib.crc32, data), np.int64, len(data))
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(sizes[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(data, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut, _PIECES + (", ids binary" if with_ids else ""))


def patterns(histogram: dict[int, int], most: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: patterns of lengths, each with its count of packs. Lengths in a pattern are in placing order.

    The same packs as placing piece by piece, longest first, each into the open pack with the most room, the smallest pattern
    among equals, and into a new pack where none has room.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left
    full: dict[tuple[int, ...], int] = defaultdict(int)

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if room:
            open_packs[room][pattern] = open_packs[room].get(pattern, 0) + count
        else:
            full[pattern] += count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # A pack that gets a piece has less room then, so going down meets it again if it holds another one.
        for room in range(most, length - 1, -1):
            packs_of = open_packs.get(room)
            while packs_of and left:
                pattern = min(packs_of)
                count = packs_of.pop(pattern)
                n = min(count, left)
                put(pattern + (length,), n, room - length)
                left -= n
                if count > n:
                    packs_of[pattern] = count - n
            if not left:
                break
        # No open pack has room: a new one is the pack with the most room for this length until it's full.
        per = most // length
        if left >= per:
            put((length,) * per, left // per, most - per * length)
        if left % per:
            put((length,) * (left % per), 1, most - left % per * length)
    for packs_of in open_packs.values():
        for pattern, count in packs_of.items():
            full[pattern] += count
    return sorted(full.items(), reverse=True)


def intervals(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces a sequence, offset): rows in rank order for each length.

    The r-th piece of an interval, from 0, is in sequence first + r // m, at offset + r % m * length. There are at most as many
    rows as different lengths times patterns that hold them, whatever the number of pieces.
    """
    rank: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in packed:
        offset, k = 0, 0
        while k < len(pattern):
            length, m = pattern[k], 1
            while k + m < len(pattern) and pattern[k + m] == length:
                m += 1
            out.append((length, rank[length], sequence, m, offset))
            rank[length] += m * count
            offset += m * length
            k += m
        sequence += count
    return out


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """rows, a staged table, with `rank`: a number from 0 within their length, gapless.

    The number within (length, salt) is a window over a small part of a length's rows; the salts' counts give where it starts.
    """
    salts = max(SALTS, -(-max(histogram.values()) // PIECES_A_SALT))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "nth"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("_l"), F.col("salt").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "nth")) - 1
    rows = rows.withColumn("own", own)
    return rows.join(counts, (F.col("length") == F.col("_l")) & (F.col("salt") == F.col("_s"))).withColumn("rank", F.col("first") + F.col("own")).drop("_l", "_s", "first", "own", "salt", "nth")


def pack(cut: DataFrame, root: str) -> DataFrame:
    """cut (any rows with doc_id, start, length and ids_crc32) with sequence_id and offset."""
    rows = stage(cut.withColumn("nth", F.monotonically_increasing_id()), f"{root}/pieces")
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    if not histogram:
        return rows.select(*cut.columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = ranked(rows, histogram)
    # At most some thousand rows: no more than lengths times the patterns that hold them.
    table = np.array(sorted(intervals(patterns(histogram))), np.int64).T
    starts, names = table[0] * _RANKS + table[1], cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            _, first, sequence, m, offset = table[:, np.searchsorted(starts, length * _RANKS + rank, "right") - 1]
            nth = rank - first
            placed = [pa.array(sequence + nth // m), pa.array(offset + nth % m * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *placed], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return map_arrow(rows.select(*names, "rank"), place, f"{kinds}, sequence_id bigint, offset bigint")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack(pieces(docs), work_dir(docs.sparkSession, "packing"))


def sequences(docs: DataFrame) -> DataFrame:
    """The packed corpus: one row a sequence, with its ids and the pieces they come from in order."""
    rows = pack(pieces(docs, with_ids=True), work_dir(docs.sparkSession, "packing"))
    grouped = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    plain = F.transform("p", lambda x: F.struct(x.offset.alias("offset"), x.doc_id.alias("doc_id"), x.start.alias("start"), x.length.alias("length")))
    ids = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x.ids))
    return grouped.select("sequence_id", plain.alias("pieces"), ids.alias("ids"))
