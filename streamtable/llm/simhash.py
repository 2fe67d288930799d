"""SimHash near-dedup with pivot distance tables.

Fingerprints are made from hashed word shingles; documents with one fingerprint are one class from then on. Classes are linked
where their fingerprints differ in few bits, in all cases and without any pair table of a group:

1. Candidates. The 64 bits are cut into six blocks. Two fingerprints that differ in 4 bits at most agree on two whole blocks at
   least, so each is dealt out under its 15 pairs of blocks, and links are only looked for within a bucket. For so many
   fingerprints that all such buckets would be crowded there are seven blocks of which three agree, or eight of which four do.
2. Pivots. The Hamming distances of a fingerprint to PIVOTS fixed reference fingerprints are computed once and go with it as two
   longs of eight bytes each. If two fingerprints differ in k bits, no coordinate of their rows differs by more than k: pairs with
   a larger maximum coordinate difference are discarded, and the distance of the survivors is verified.
3. Buckets. Rows come sorted by bucket, and numpy compares rows a few places apart for all small buckets at once. In a larger one
   rows are sorted by their first pivot distance, so each row only meets those within reach. A bucket gives a spanning forest of
   its links, never its pairs: fewer links than rows.
4. Crowded buckets, of more than CROWD fingerprints, are counted before the rows are dealt out and go another, exact way. Their
   rows are dealt out once more, under sub-blocks of the free bits (8 sub-blocks, of which 4 agree at least), and buckets that
   are still crowded are linked through midpoints: two fingerprints differ in 4 bits at most exactly if there is a third one
   that differs in 2 at most from both. Rows join on these, so that way needs no comparison of rows at all.

Components of the links come from alternating large-star and small-star rounds over a table of links, as many as it takes. Nothing
of the corpus' size goes to the driver.

Defined cases: a text without words has fingerprint zero, and such documents are linked like others; a null text has no words;
fewer words than a shingle make one shingle; rows with one id are separate rows, and the component's id is the smallest id in it
(null ids are ignored there, and a component without any other id has null); of a very long text all shingles count, a bounded part
of their bits at a time; texts with one fingerprint tie and are one class; an empty table gives an empty result; other columns are
ignored, or kept under their own names by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from streamtable.llm.common import LOWER, UPPER, map_arrow, sieved, stage, work_dir
from streamtable.operators.relational import salted_join

SEED = 42
BITS = 64
DISTANCE = 4
PIVOTS = 16
CROWD = 4096
#: Fingerprints up to which so many blocks are cut; some of them, all but DISTANCE, make a bucket's key.
BLOCKS = ((1 << 26, 6), (1 << 31, 7), (None, 8))
SUB_BLOCKS = 8
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _split_lower(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    # bytes.split() splits at ASCII white space alone, the contract's six characters.
    w = _split_lower(text or "")
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(w[k : k + words]), SEED) for k in range(n)), np.uint64, n)


def _fold(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones, n = np.zeros(BITS, np.int64), len(h)
    for k in range(0, n, 1 << 16):  # bounds the bit table of a long text
        ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of one text; 0 without words."""
    return _fold(_shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int, *carried: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), p0 and p1 (its pivot row, a byte a pivot) and the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column("text")), np.uint64, batch.num_rows)
            names = ["doc_id", *carried]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, (fps.view(np.int64), *packed_rows(fps, refs)))], names=[*names, "fp", "p0", "p1"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, "text")
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return map_arrow(rows, run, f"{kinds}, fp bigint, p0 bigint, p1 bigint")


def _masks(widths: tuple[int, ...]) -> list[int]:
    out, at = [], 0
    for w in widths:
        out.append(((1 << w) - 1) << at)
        at += w
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ways(blocks: int) -> list[int]:
    """The bits that each choice of all but DISTANCE of the blocks covers."""
    widths = tuple(BITS // blocks + (k < BITS % blocks) for k in range(blocks))
    return [sum(c) for c in combinations(_masks(widths), blocks - DISTANCE)]


def dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, way, key): each fingerprint under the bits of each way, with its other columns."""
    deal = F.array(*(F.struct(F.lit(k).cast("int").alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)))
    return fps.select("*", F.inline(deal))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints by rule: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(k), SEED) for k in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, one row for each reference fingerprint."""
    return np.bitwise_count(fps[None, :] ^ refs[:, None]).astype(np.int8)


def packed_rows(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The table's columns, a fingerprint's row each, as two longs."""
    return np.ascontiguousarray(np.ascontiguousarray(pivot_table(fps, refs).T).view("<i8").T)


def unpacked_rows(*parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(np.stack(parts, axis=1)).astype("<i8", copy=False).view(np.int8).T)


def _linked(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which of the pairs are links: by maximum coordinate difference one pivot after the other, then by their distance."""
    live = np.arange(len(i))
    for row in table:
        if not len(live):
            break
        live = live[np.abs(row[i[live]] - row[j[live]]) <= distance]
    return live[np.bitwise_count(fps[i[live]] ^ fps[j[live]]) <= distance]


def _forest(table: np.ndarray, distance: int, linked) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket, as places in it. linked(i, j): which of the pairs are links.

    A row is only compared with rows that aren't connected with it yet, so a dense bucket is done after a few rows.
    """
    order = np.argsort(table[0], kind="stable")
    first, n = table[0][order].astype(np.int64), len(order)
    label = np.arange(n)
    out = []
    for k in range(n):
        end = int(np.searchsorted(first, first[k] + distance, "right"))
        others = np.arange(k + 1, end)
        others = others[label[others] != label[k]]
        if not len(others):
            continue
        found = others[linked(np.full(len(others), order[k]), order[others])]
        for x in found[np.unique(label[found], return_index=True)[1]].tolist():
            label[label == label[x]] = label[k]
            out.append((int(order[k]), int(order[x])))
    return out


def links_in_order(bucket: np.ndarray, fps: np.ndarray, table: np.ndarray, small: int = 32, distance: int = DISTANCE, signatures: np.ndarray | None = None) -> np.ndarray:
    """Links (two columns of places) within buckets; equal numbers in `bucket` lie together. table: the pivot distances.

    With signatures (a row for each fingerprint) linked rows must also agree in AGREE of their bytes.
    """

    def linked(i: np.ndarray, j: np.ndarray, shift: int = 0) -> np.ndarray:
        live = _linked(fps, table, i + shift, j + shift, distance)
        if signatures is not None:
            live = live[(signatures[i[live] + shift] == signatures[j[live] + shift]).sum(1) >= AGREE]
        return live

    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(bucket)])))
    of_row = np.repeat(sizes, sizes)
    out = []
    rows = np.flatnonzero((of_row > 1) & (of_row <= small))
    ends = np.repeat(starts + sizes, sizes)
    step = 1
    while len(rows):
        rows = rows[rows + step < ends[rows]]
        found = rows[linked(rows, rows + step)]
        if len(found):
            out.append(np.stack([found, found + step]))
        step += 1
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        pairs = _forest(table[:, s : s + n], distance, lambda i, j, s=s: linked(i, j, s))
        if pairs:
            out.append(np.array(pairs).T + s)
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def bucket_links(rows: DataFrame, *key: str, node: str = "fp", distance: int = DISTANCE, signature: str | None = None) -> DataFrame:
    """(u, v), pairs of nodes, from rows of (node, fp, p0, p1, *key). A bucket has CROWD rows at most: it is held in memory, others in batches."""
    columns = list(dict.fromkeys([*key, node, "fp", "p0", "p1", *([signature] if signature else [])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                keys = [np.asarray(t.column(c)) for c in key]
                new = np.any([np.concatenate(([True], k[1:] != k[:-1])) for k in keys], axis=0)
                # A row that has its bucket to itself has no links.
                shared = ~(new & np.concatenate((new[1:], [True])))
                t, new = t.filter(pa.array(shared)), new[shared]
                if not t.num_rows:
                    return
                marks = np.frombuffer(b"".join(t.column(signature).to_pylist()), np.uint8).reshape(t.num_rows, -1) if signature else None
                table = unpacked_rows(np.asarray(t.column("p0")), np.asarray(t.column("p1")))
                i, j = links_in_order(np.cumsum(new), np.asarray(t.column("fp")).view(np.uint64), table, distance=distance, signatures=marks)
                if len(i):
                    nodes = np.asarray(t.column(node))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j])], names=["u", "v"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                now = pa.concat_tables([held, now])
            if not now.num_rows:
                continue
            # The last bucket may go on in the next batch.
            last = np.all([(k := np.asarray(now.column(c))) == k[-1] for c in key], axis=0)
            cut = int(np.argmax(last))
            yield from links(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield from links(held)

    rows = rows.select(*columns).repartition(*key).sortWithinPartitions(*key)
    return map_arrow(rows, run, "u bigint, v bigint")


def _split_crowds(rows: DataFrame, path: str, crowd: int, *key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows of buckets up to `crowd`, rows of larger ones or None). Sizes come from partial counts, before any row is dealt out."""
    large = stage(rows.groupBy(*key).count().where(F.col("count") > crowd).select(*key), path)
    if large.isEmpty():
        return rows, None
    return rows.join(large, [*key], "left_anti"), rows.join(large, [*key], "left_semi")


def _popcount_masks(free: int, most: int) -> list[int]:
    """All sets of up to `most` bits out of the free ones."""
    bits = [1 << k for k in range(BITS) if free >> k & 1]
    return [sum(c) for n in range(most + 1) for c in combinations(bits, n)]


def _sub_ways(mask: int) -> list[int]:
    """The bits of four out of eight sub-blocks of what a way leaves free."""
    free = [1 << k for k in range(BITS) if not mask >> k & 1]
    subs = [sum(free[k::SUB_BLOCKS]) for k in range(SUB_BLOCKS)]
    return [sum(c) for c in combinations(subs, SUB_BLOCKS - DISTANCE)]


def links(fps: DataFrame, root: str, crowd: int = CROWD, blocks: int | None = None) -> DataFrame:
    """(u, v): links between different fingerprints that have the components of all pairs within DISTANCE bits.

    fps: a staged table of (fp, p0, p1).
    """
    if blocks is None:
        n = fps.count()
        blocks = next(b for most, b in BLOCKS if most is None or n <= most)
    masks = ways(blocks)
    calm, crowded = _split_crowds(dealt(fps, masks), f"{root}/crowded-1", crowd, "way", "key")
    out = bucket_links(calm, "way", "key")
    if crowded is not None:
        # A row for each way, whatever the input.
        table = fps.sparkSession.createDataFrame([(k, [_signed(x) for x in _sub_ways(m)]) for k, m in enumerate(masks)], "way int, subs array<long>")
        subs = crowded.join(F.broadcast(table), "way").select(*crowded.columns, F.posexplode("subs").alias("sub", "mask"))
        subs = subs.withColumn("sub_key", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")
        keys = ("way", "key", "sub", "sub_key")
        calm, crowded = _split_crowds(subs, f"{root}/crowded-2", crowd, *keys)
        out = out.unionByName(bucket_links(calm, *keys))
        if crowded is not None:
            out = out.unionByName(midpoint_links(crowded, masks))
    return out


def midpoint_links(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Links through midpoints for rows of (fp, way, sub) that agree on the bits of way and sub.

    Both ends of a link differ from a midpoint in the free bits alone. Each midpoint links its rows to the smallest of them, and
    two rows of one midpoint differ in 4 bits at most, so all these are links; the smallest is a partial aggregate.
    """
    everything = (1 << BITS) - 1
    table = [(k, s, [_signed(x) for x in _popcount_masks(everything & ~m & ~sub, DISTANCE // 2)]) for k, m in enumerate(masks) for s, sub in enumerate(_sub_ways(m))]
    spark = rows.sparkSession
    # At most 4,900 rows of about 150 numbers, whatever the input.
    balls = F.broadcast(spark.createDataFrame(table, "way int, sub int, ball array<long>"))
    points = rows.select("fp", "way", "sub").join(balls, ["way", "sub"]).select("fp", F.explode(F.transform("ball", lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    least = points.groupBy("mid").agg(F.min("fp").alias("v"))
    return points.join(least, "mid").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v").distinct()


def components(edges: DataFrame, root: str) -> DataFrame:
    """(node, top) for all nodes of the links (u, v): top is the component's smallest node.

    Large-star and small-star rounds; each gives every node at most one link to a smaller one and its other links to that, so
    the table never grows, and the number of rounds is about the logarithm of a component's size. Both sides of a round's joins
    are staged tables, so that adaptive execution can split the links of a hub.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now, mark = _marked(edges.where("u <> v").select(big.alias("u"), small.alias("v")).distinct(), f"{root}/links-0")
    for k in count(1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{root}/large-least-{k}")
        # Large star: neighbours above a node are linked to the least of the node and all its neighbours.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, f"{root}/large-{k}")
        # Small star: the node and its neighbours below it are linked to the least of them.
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), f"{root}/small-least-{k}")
        rest = large.join(least, "u")
        now = rest.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now, new = _marked(now, f"{root}/links-{k}")
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("top"))
        mark = new


def _marked(edges: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """The links, staged, with their number and an order-free checksum, taken as they are written."""
    seen = Observation()
    edges = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum"))
    return stage(edges, path), seen.get


def classified(docs: DataFrame, words: int, root: str | None = None, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs."""
    root = root or work_dir(docs.sparkSession, "simhash")
    rows = stage(fingerprints(docs, words), f"{root}/fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.first("p0").alias("p0"), F.first("p1").alias("p1"))
    classes = stage(classes, f"{root}/classes")
    found = components(links(classes.select("fp", "p0", "p1"), root, crowd), root)
    return _with_component(rows.select("doc_id", "fp"), classes, found, "fp", root)


def _with_component(rows: DataFrame, classes: DataFrame, found: DataFrame, key: str, root: str) -> DataFrame:
    """rows with component_id, the smallest least_id that the classes of one component have. Joins are of staged tables."""
    tops = classes.join(found, F.col(key) == F.col("node"), "left") if key != "node" else classes.join(found, "node", "left")
    tops = stage(tops.select(F.col(key).alias("_key"), "least_id", F.coalesce("top", F.col(key)).alias("top")), f"{root}/tops")
    least = stage(tops.groupBy("top").agg(F.min("least_id").alias("component_id")), f"{root}/tops-least")
    of_class = stage(tops.join(least, "top").select("_key", "component_id"), f"{root}/class-components")
    return rows.join(of_class, F.col(key) == F.col("_key")).drop("_key")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: shingles of 4 words, links of 4 bits at most."""
    return classified(docs, words=4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity. A few bits of difference are a close copy; texts whose shingles agree by 0.8 differ in up to 13 of 64
# bits, for which no dealing out by equal bits is selective. So buckets come from the smallest shingle hashes instead, within them
# pivots and fingerprints discard, and an estimate from signatures is a loose filter. The components of what is left hold all
# similar pairs, and within each of them the sets of shingle hashes themselves decide.
#
# A component that is too large to be held is taken apart without comparing all its pairs: its sets are compared with one of
# them, the centre. Jaccard distance is a metric, so sets within 0.2 of the centre are connected, and of these only such can be
# similar to one outside that are no more than 0.2 nearer to the centre than the nearest outside. What remains is dealt out anew,
# under the rarest fifth of each set's hashes (two similar sets share one of these), into smaller components.

SHINGLE = 5
SIMILARITY = 0.8
#: Smallest hashes under so many multipliers; one byte of each is kept as the signature.
HASHES = 128
#: Three of them make a bucket's key: of two texts with a similarity of 0.8, all but 1 in 100,000 share one of sixteen.
BANDS, PER_BAND = 16, 3
#: Bytes of two signatures that must agree: 0.8 less over four standard errors of the estimate, as a loose filter.
AGREE = 82
#: Bits that fingerprints may differ in: 13 at a similarity of 0.8, and three standard deviations more.
FAR = 24
#: Shingle hashes that are compared in one bucket at most, unless two texts have more.
CROWD_HASHES = 2_000_000


def _multipliers() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"multiplier {k}", SEED) | 1 for k in range(HASHES)], np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def sketches(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (a hash of the words), fp (of the set of shingles) with its pivot row, signature and bands, for documents that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, refs = _multipliers(), pivots()
        for batch in batches:
            ids, texts, nodes, fps, marks, bands = [], [], [], [], [], []
            for i, x, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text")):
                h = _shingle_hashes(text.as_py(), words)
                if not len(h):
                    continue
                nodes.append(xxhash.xxh64_intdigest(h.tobytes()))
                h = np.unique(h)
                least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
                for k in range(0, len(h), 1024):
                    least = np.minimum(least, (h[k : k + 1024, None] * factors).min(0))
                ids.append(i)
                texts.append(x)
                fps.append(_fold(h))
                marks.append(least.astype(np.uint8).tobytes())
                raw = least[: BANDS * PER_BAND].astype("<u8").tobytes()
                bands.append([xxhash.xxh64_intdigest(raw[b * 8 * PER_BAND : (b + 1) * 8 * PER_BAND]) for b in range(BANDS)])
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), long([x for b in bands for x in b]))
            rows = packed_rows(np.array(fps, np.uint64), refs)
            columns = [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), long(nodes), long(fps), *map(pa.array, rows), pa.array(marks, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "fp", "p0", "p1", "signature", "bands"])

    return map_arrow(_texts(docs), run, "doc_id bigint, text_hash bigint, node bigint, fp bigint, p0 bigint, p1 bigint, signature binary, bands array<bigint>")


def similar_links(texts: DataFrame, root: str, crowd: int = CROWD) -> DataFrame:
    """(u, v): links between nodes whose texts may be similar, from rows of (node, fp, p0, p1, signature, bands), one a node."""
    return _loose_links(texts.select("node", "fp", "p0", "p1", "signature", F.posexplode("bands").alias("way", "key")), f"{root}/shared", crowd, "way", "key")


def _loose_links(rows: DataFrame, path: str, crowd: int, *key: str) -> DataFrame:
    """Links within buckets. All of a bucket with more than `crowd` rows are linked to its smallest node, without any filter.

    Most rows have their buckets to themselves; of these only the key and the node are moved.
    """
    shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    shared = stage(shared, path)
    rows = sieved(rows, F.xxhash64(*key), shared, F.xxhash64(*key), f"{path}-sieve").where("_maybe").drop("_maybe")
    large = shared.where(F.col("n") > crowd)
    if large.isEmpty():
        return bucket_links(rows, *key, node="node", distance=FAR, signature="signature")
    out = bucket_links(rows.join(large.select(*key), [*key], "left_anti"), *key, node="node", distance=FAR, signature="signature")
    return out.unionByName(rows.select("node", *key).join(large.select(*key, "least"), [*key]).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))


def _pairs_of_parts(rows: DataFrame) -> DataFrame:
    """Rows with the number of their bucket's parts, under each pair (low, high) of parts that has their own."""
    cut = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return cut.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def shingle_sets(docs: DataFrame, members: DataFrame, words: int, root: str) -> DataFrame:
    """(node, top, size, hashes): the set of shingle hashes, sorted, of each member, rows of (node, top, doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingle_hashes(x.as_py(), words)) for x in batch.column("text")]
            columns = [batch.column("node"), batch.column("top"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "top", "size", "hashes"])

    own = members.select("node", "top", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    # Only texts that may be members' are moved.
    texts = sieved(_texts(docs), F.xxhash64("doc_id", "text_hash"), own, F.xxhash64("_id", "_hash"), f"{root}/sets-sieve").where("_maybe")
    found = texts.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    found = found.groupBy("node").agg(F.first("top").alias("top"), F.first("text").alias("text"))
    return stage(map_arrow(found, run, "node bigint, top bigint, size bigint, hashes binary"), f"{root}/sets")


def set_forest(sets: list[np.ndarray], classes: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with a Jaccard similarity of SIMILARITY at least, as places. The sets aren't empty; those of
    one class are known to be connected.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    size = np.array([len(sets[k]) for k in order])
    start = np.cumsum(size) - size
    ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    flag = np.zeros(len(ids), np.int32)
    label = np.arange(len(order)) if classes is None else np.unique([classes[k] for k in order], return_inverse=True)[1]
    least, out = round(SIMILARITY * 100), []
    for k in range(len(order)):
        # Larger sets can't be similar: the smaller one's size is the intersection's at most.
        others = np.arange(k + 1, int(np.searchsorted(size, size[k] * 100 // least, "right")))
        others = others[label[others] != label[k]]
        if not len(others):
            continue
        own = ids[start[k] : start[k] + size[k]]
        n = size[others]
        first = np.cumsum(n) - n
        flag[own] = 1
        common = np.add.reduceat(flag[ids[np.repeat(start[others] - first, n) + np.arange(n.sum())]], first)
        flag[own] = 0
        found = others[100 * common >= least * (size[k] + n - common)]
        for x in found[np.unique(label[found], return_index=True)[1]].tolist():
            label[label == label[x]] = label[k]
            out.append((order[k], order[x]))
    return out


def _forests(sets: DataFrame, *key: str) -> DataFrame:
    """(u, v): a spanning forest of the similar pairs in each group of rows (node, class, hashes, *key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, classes, held = None, [], [], []

        def links() -> Iterator[pa.RecordBatch]:
            pairs = set_forest(held, classes) if len(held) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            for now, node, own, hashes in zip(keys, batch.column("node").to_pylist(), batch.column("class").to_pylist(), batch.column("hashes")):
                if now != at:
                    yield from links()
                    at, nodes, classes, held = now, [], [], []
                nodes.append(node)
                classes.append(own)
                held.append(np.frombuffer(hashes.as_py(), np.uint64))
        yield from links()

    rows = sets.select(*key, "node", "class", "hashes").repartition(*key).sortWithinPartitions(*key)
    return map_arrow(rows, run, "u bigint, v bigint")


def _needs(sets: DataFrame, crowd: int, path: str) -> DataFrame:
    """(top, parts): into how many parts a group must be cut to be held in memory."""
    need = F.greatest(F.count(F.lit(1)) / crowd, F.sum("size") / CROWD_HASHES)
    return stage(sets.groupBy("top").agg(F.least(F.when(need > 1, F.ceil(need * 2)).otherwise(1), F.count(F.lit(1))).cast("long").alias("parts")), path)


def exact_links(sets: DataFrame, sketch: DataFrame, root: str, crowd: int = CROWD) -> DataFrame:
    """(u, v): links between nodes of one `top` that have the components of all its similar pairs, from shingle_sets() and each
    node's (node, fp, p0, p1, signature).
    """
    needs = _needs(sets, crowd, f"{root}/needs")
    large = needs.where("parts > 1")
    calm = sets.withColumn("class", F.col("node"))
    if large.isEmpty():
        return _forests(calm, "top")
    out = _forests(calm.join(large.select("top"), ["top"], "left_anti"), "top")
    star = _star(sets.join(large.select("top"), ["top"], "left_semi"), root)
    out = out.unionByName(star.where("near AND node <> centre").select(F.col("node").alias("u"), F.col("centre").alias("v")))
    # A hair more than 0.2, as these are quotients.
    edge = star.where("NOT near").groupBy("top").agg((F.min("far") - (1 - SIMILARITY) - 1e-9).alias("edge"))
    rest = star.join(stage(edge, f"{root}/edges"), ["top"]).where("NOT near OR far >= edge").select("node", F.when(F.col("near"), F.col("centre")).otherwise(F.col("node")).alias("class"))
    rest = stage(sets.join(rest, ["node"]).join(sketch, ["node"]), f"{root}/rest")
    loose = components(_loose_links(stage(rare_keys(rest), f"{root}/rare-keys"), f"{root}/rare", crowd, "top", "key"), f"{root}/rare-loose")
    loose = stage(loose.unionByName(loose.select(F.col("top").alias("node"), "top").distinct()), f"{root}/rare-tops")
    again = rest.drop("top").join(loose, "node")
    # Groups that are too large even so are cut into parts, and each pair of parts is a group of its own.
    cut = _pairs_of_parts(again.join(_needs(again, crowd, f"{root}/needs-2"), ["top"]))
    return out.unionByName(_forests(cut, "top", "low", "high"))


def _star(sets: DataFrame, root: str) -> DataFrame:
    """(top, node, centre, far, near): each set's Jaccard distance from its group's centre, and whether it is similar to that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = round(SIMILARITY * 100)
        for batch in batches:
            far, near = [], []
            for one, other in zip(batch.column("hashes"), batch.column("others")):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (one, other))
                common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                either = len(a) + len(b) - common
                far.append(1 - common / either)
                near.append(100 * common >= least * either)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("top", "node", "centre")), pa.array(far), pa.array(near)], names=["top", "node", "centre", "far", "near"])

    centres = sets.groupBy("top").agg(F.min("node").alias("centre"))
    centres = stage(centres.join(sets.select(F.col("node").alias("centre"), F.col("hashes").alias("others")), ["centre"]), f"{root}/centres")
    both = salted_join(sets.select("top", "node", "hashes"), centres, ["top"], 16)
    return stage(map_arrow(both.select("top", "node", "centre", "hashes", "others"), run, "top bigint, node bigint, centre bigint, far double, near boolean"), f"{root}/star")


#: Counters of hashes by their first bits, 2**20 on the driver whatever the input; any order of hashes gives right results.
COUNTER_BITS = 20


def rare_keys(sets: DataFrame) -> DataFrame:
    """(top, key, node, *sketch): each set under the rarest of its hashes, as many as similar sets can't all lack.

    Two sets with a similarity of s have at least the share s of either in common, so of any order of all hashes the first ones,
    all but that share and one more, can't be without a common one. Hashes that are nowhere else make no row.
    """
    shift = np.uint64(64 - COUNTER_BITS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for x in batch.column("hashes"):
                np.add.at(total, (np.frombuffer(x.as_py(), np.uint64) >> shift).astype(np.int64), 1)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    found = map_arrow(sets.select("hashes"), counted, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(1 << COUNTER_BITS, np.int32)
    counters[np.asarray(found.column("k"))] = np.minimum(np.asarray(found.column("n")), 1 << 30)
    names = ["top", "node", "fp", "p0", "p1", "signature"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        percent = round(SIMILARITY * 100)
        for batch in batches:
            keys, of = [], []
            for k, x in enumerate(batch.column("hashes")):
                h = np.frombuffer(x.as_py(), np.uint64)
                n = counters[(h >> shift).astype(np.int64)]
                first = np.lexsort((h, n))[: len(h) - -(-percent * len(h) // 100) + 1]
                first = first[n[first] > 1]
                keys.append(h[first])
                of.append(np.full(len(first), k))
            rows = pa.array(np.concatenate(of)) if of else pa.array([], pa.int64())
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in names), pa.array(key)], names=[*names, "key"])

    return map_arrow(sets.select(*names, "hashes"), deal, "top bigint, node bigint, fp bigint, p0 bigint, p1 bigint, signature binary, key bigint")


def similar_classes(docs: DataFrame, words: int = SHINGLE, root: str | None = None, crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) for the documents that have words: the smallest id that similar texts lead to.

    Texts with equal words are one node; of rows with one id and text any is taken, as they are interchangeable; a null id counts
    as no id. A text with fewer words than a shingle is one shingle, so such texts are similar only if their words are equal.
    """
    root = root or work_dir(docs.sparkSession, "similar")
    rows = stage(sketches(docs, words), f"{root}/sketches")
    sketch = ["fp", "p0", "p1", "signature"]
    place = F.max(F.struct("doc_id", "text_hash")).alias("place")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), place, *(F.first(c).alias(c) for c in (*sketch, "bands")))
    nodes = stage(nodes, f"{root}/nodes")
    loose = components(similar_links(nodes, root, crowd), f"{root}/loose")
    loose = loose.unionByName(loose.select(F.col("top").alias("node"), "top").distinct())
    members = stage(nodes.select("node", "place.*").join(loose, "node"), f"{root}/members")
    exact = exact_links(shingle_sets(docs, members, words, root), nodes.select("node", *sketch), root, crowd)
    found = components(exact, f"{root}/exact")
    return _with_component(rows.select("doc_id", "node"), nodes.select("node", "least_id"), found, "node", root).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """docs without the near-duplicates: of each component the rows with its smallest id, all of them if several have that id.
    Documents without words or id stay, and so does every column under its own name.
    """
    root = work_dir(docs.sparkSession, "keep-one")
    gone = stage(similar_classes(docs, words, root).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), f"{root}/gone")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    # Only rows whose ids may be gone are moved.
    rows = sieved(packed, F.xxhash64(F.col("d.doc_id").cast("long")), gone, F.xxhash64("_id"), f"{root}/gone-sieve")
    doubtful = rows.where("_maybe").join(gone, F.col("d.doc_id") == F.col("_id"), "left_anti")
    return rows.where("NOT _maybe").union(doubtful).select("d.*")
