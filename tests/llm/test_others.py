"""Near-dedup, toxicity, media and HTML."""

import hashlib
import io
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from streamtable.llm import html_text, media, simhash, toxicity
from streamtable.llm.common import sieved, stage, work_dir
from tests.conftest import DATA
from tests.llm.fixtures import ROWS, clashing, docs, shuffled


def brute_fingerprint(t, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    f, top = np.array(fps, np.uint64), list(range(len(fps)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(f)):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1 :] ^ f[a]) <= 4) + a + 1:
            x, y = find(a), find(int(b))
            if x != y:
                top[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(f))]


@pytest.mark.parametrize("which", ["real", "odd"])
def test_simhash(spark, which):
    df = spark.read.parquet(f"{DATA}/documents.parquet") if which == "real" else clashing(docs(spark, [r for r in ROWS if r[0] != 10]))
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    classes = brute_classes(fps)
    least = {}
    for (i, _), c in zip(rows, classes):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, format(f, "016x"), least.get(c)) for (i, _), f, c in zip(rows, fps, classes)), key=repr)
    assert sorted(map(tuple, simhash.digest(df).collect()), key=repr) == want


def test_simhash_empty_and_long(spark):
    assert simhash.digest(docs(spark, [])).count() == 0
    assert simhash.fingerprint(ROWS[10][1], 4) == brute_fingerprint(ROWS[10][1])


@pytest.mark.parametrize("crowd, blocks", [(4096, None), (30, 6), (2, 6), (4096, 7), (30, 7), (4096, 8), (2, 8)])
def test_all_links_are_found(spark, crowd, blocks):
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(0, 1 << 63, 3):
        for _ in range(150):
            x = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps | {int(x) for x in rng.integers(0, 1 << 63, 100)})
    classes = brute_classes(fps)
    root = work_dir(spark, "links")
    rows = simhash.packed_rows(np.array(fps, np.uint64), simhash.pivots())
    df = spark.createDataFrame([(simhash._signed(x), *map(int, p)) for x, p in zip(fps, rows.T)], "fp long, p0 long, p1 long")
    found = {r.node: r.top for r in simhash.components(simhash.links(df, root, crowd, blocks), root).collect()}
    got = [found.get(simhash._signed(x), simhash._signed(x)) for x in fps]
    assert len(set(zip(got, classes))) == len(set(got)) == len(set(classes))


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    f = np.concatenate([a, b])
    table = simhash.pivot_table(f, simhash.pivots())
    assert len(simhash._linked(f, table, np.arange(2000), np.arange(2000, 4000))) == 2000
    assert (simhash.unpacked_rows(*simhash.packed_rows(f, simhash.pivots())) == table).all()


def test_large_buckets_give_a_forest():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 40, 300).astype(np.uint64)), rng.integers(0, 1 << 63, 200).astype(np.uint64)]))
    u, v = fps[simhash.links_in_order(np.zeros(len(fps), int), fps, simhash.pivot_table(fps, simhash.pivots()))]
    assert len(u) < len(fps)
    assert (np.bitwise_count(u ^ v) <= 4).all()
    classes = brute_classes(fps.tolist())
    assert len(u) == len(fps) - len(set(classes))


def test_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long")
    found = simhash.components(edges, work_dir(spark, "chain")).collect()
    assert {r.top for r in found} == {0} and len(found) == 200


def test_keep_one(spark):
    text = " ".join(f"alpha{k} beta" for k in range(200))
    rows = [(1, text, "en", "a", 0), (2, text, "en", "a", 0), (3, "something else entirely that is here", "en", "b", 0), (4, "", "en", "a", 0), (5, None, "en", "a", 0)]
    out = simhash.keep_one(clashing(docs(spark, rows)))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5] and out.columns == clashing(docs(spark, rows)).columns


def similarity(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("crowd", [4096, 6])
def test_similar_texts(spark, crowd):
    """Copies with a few words changed are one class, half copies and others are not."""
    rng = np.random.default_rng(4)
    rows, group = [], {}
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for k in range(1 if g > 8 else 9):
            w = list(base)
            for at in rng.integers(0, 300, 4 * bool(k)):
                w[at] = f"new{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w), "en", "a", 0))
            group[len(rows) - 1] = g
        half = base[:150] + [f"v{x}" for x in rng.integers(0, 5000, 150)]
        rows.append((len(rows), " ".join(half), "en", "a", 0))
        group[len(rows) - 1] = 100 + g
    assert similarity(rows[0][1], rows[1][1]) > 0.85
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs(spark, rows), crowd=crowd).collect()}
    first = {}
    for i, g in group.items():
        assert got[i] == first.setdefault(g, i)


@pytest.mark.parametrize("crowd", [4096, 6])
def test_similar_texts_near_the_threshold(spark, crowd):
    """Pairs at 0.70 to 0.82, with repeats, and a family of pages around 0.7 against brute force."""
    rng = np.random.default_rng(5)
    texts = []
    for want in (0.70, 0.75, 0.78, 0.79, 0.80, 0.81, 0.82):
        for _ in range(12):
            # n words have n - 4 shingles; the copy goes on with other words, so that common / all is as wanted.
            common, own = 200, round((200 / want - 200) / 2)
            base = [f"w{x}" for x in rng.integers(0, 10**6, common + 4)]
            a, b = ([*base, *(f"{c}{x}" for x in rng.integers(0, 10**6, own))] for c in "xy")
            assert round(similarity(" ".join(a), " ".join(b)), 2) == pytest.approx(want, abs=0.011)
            texts += [" ".join(a), " ".join(b)]
    page = [f"p{x}" for x in rng.integers(0, 10**6, 254)]
    texts += [" ".join([*page, *(f"q{x}" for x in rng.integers(0, 10**6, 50))]) for _ in range(60)]
    phrase = [f"r{x}" for x in rng.integers(0, 10**6, 20)]
    texts += [" ".join(phrase * 3), " ".join(phrase * 40)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and want[i] != want[j]:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    assert 20 < len(texts) - len(set(want)) < 60
    rows = [(k, t, "en", "a", 0) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs(spark, rows), crowd=crowd).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_recall_of_similar_texts(spark):
    """Every document whose id 20 divides, against all documents: pairs at 0.8 and at 0.85 or more that are in one class."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    texts = {r.doc_id: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) if w] for r in df.collect()}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items() if w}
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(df).collect()}
    for least in (0.8, 0.85):
        pairs = [(i, j) for i in sets if i % 20 == 0 for j in sets if i != j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
        assert len(pairs) > 5 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_texts_that_stay_are_not_moved(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:08x}" for x in rng.integers(1 << 32, size=4000)) for _ in range(60)]
    rows = [(k, x) for k, x in enumerate([*texts, texts[0] + " more"])] + [(None, texts[1])]
    df = stage(spark.createDataFrame(rows, "doc_id long, text string"), work_dir(spark, "test"))
    before, threshold = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        got = [r.doc_id for r in simhash.keep_one(df).collect()]
    finally:
        spark.conf.unset(threshold)
    assert sorted(x for x in got if x is not None) == list(range(60)) and got.count(None) == 1
    assert shuffled(spark) - before < 0.5 * sum(map(len, texts))


@pytest.mark.parametrize("most", [1 << 15, 1 << 17])
def test_sieve_lets_all_keys_through(spark, monkeypatch, most):
    monkeypatch.setattr("streamtable.llm.common.MOST_SIEVE_BITS", most)
    root = work_dir(spark, "test")
    keys = stage(spark.range(0, 60_000, 6).select("id"), f"{root}/keys")
    hashed = lambda: F.xxhash64("id")
    got = {r.id: r._maybe for r in sieved(spark.range(60_000), hashed(), keys, hashed(), f"{root}/sieve").collect()}
    bits = {xxhash.xxh64_intdigest(struct.pack("<q", k), 42) % most for k in range(0, 60_000, 6)}
    assert got == {k: xxhash.xxh64_intdigest(struct.pack("<q", k), 42) % most in bits for k in range(60_000)}
    assert not any(r._maybe for r in sieved(spark.range(9), hashed(), keys.where("id < 0"), hashed(), f"{root}/none").collect())


# Toxicity


def bags(n=120):
    rng = np.random.default_rng(0)
    plain = [f"w{k}" for k in range(200)]
    out = []
    for k in range(n):
        sentences = [" ".join(rng.choice(plain, 8)) + "." for _ in range(6)]
        if k % 3 == 0:
            sentences[2] = f"You {rng.choice(['blarg', 'snark'])}{rng.choice(['', 'ing', 'ed'])} w1."
        out.append((" ".join(sentences), int(k % 3 == 0)))
    return out


def test_sentences_are_located():
    model = toxicity.fit(bags())
    text = "A fine day w1 w2. Such a blargish snark here! All w5 w6\nsnarking again"
    p = model.scores(pa.array([text, "w1 w2 w3.", "", None, " \n "]))
    assert p[0] > 0.9 and p[1] < 0.2 and (p[2:] < 0.2).all()
    found = [text[a:b] for a, b, s in model.sentences(text) if s > 0.5]
    assert found == ["Such a blargish snark here!", "snarking again"]
    assert p[0] == pytest.approx(1 - np.prod([1 - s for *_, s in model.sentences(text)]))


def test_gradient_of_the_fit():
    """The gradient against differences of the loss, and the fit against any small step from it."""
    problem = toxicity.Problem([(toxicity.bag(t), y) for t, y in bags(60)])
    rng = np.random.default_rng(1)
    for _ in range(3):
        w = np.append(rng.uniform(0, 1.5, len(problem.names)), rng.uniform(-4, 0))
        _, g = problem.loss(w)
        for k in [*rng.integers(0, len(w), 8).tolist(), len(w) - 1]:
            step = np.zeros(len(w))
            step[k] = 1e-5
            assert (problem.loss(w + step)[0] - problem.loss(w - step)[0]) / 2e-5 == pytest.approx(g[k], abs=1e-6)
    model = toxicity.fit(bags(60), steps=2000)
    at = np.array([*(model.weights.get(int(f), 0.0) for f in problem.names), model.bias])
    best = problem.loss(at)[0]
    for _ in range(50):
        near = at + rng.normal(0, 0.05, len(at))
        near[:-1] = np.maximum(near[:-1], 0)
        assert problem.loss(near)[0] > best - 1e-4


def test_sample_is_bounded(spark):
    rows = [(k, f"word{k} text. " * 20, "en", "a", 0) for k in range(300)] + [(0, "word0 text. " * 20, "en", "a", 0)]
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(300)], "doc_id long, quality int, toxic int")
    held = sum(zlib.crc32(str(k).encode()) % 3 == 1 for k in range(300))
    found = toxicity.sample(docs(spark, rows), labels)
    assert len(found) == 300 - held and {y for _, y in found} == {0, 1}
    assert len(toxicity.sample(docs(spark, rows), labels, most=10)) == 20
    few = toxicity.sample(docs(spark, rows), labels, most_chars=2000)
    assert 0 < len(few) <= 2 * 2000 // 220 and all(len(b[0]) == 20 for b, _ in few)


def test_length_alone_is_not_toxic():
    model = toxicity.fit(bags())
    clean, toxic = "w2 w3 w5. ", "Such a blargish snark here! "
    assert not any(model.word(w)[0] for w in clean.split())
    p = model.scores(pa.array(["", clean, clean * 1000, clean * 100_000, clean * 1000 + toxic, toxic]))
    assert p[:4] == pytest.approx([p[0]] * 4) and p[0] < 0.2 and p[4] > 0.9 and p[4] == pytest.approx(p[5])
    text = clean * 1000 + toxic
    found = model.sentences(text)
    assert [text[a:b] for a, b, s in found if s > 0.5] == [toxic.strip()]
    assert p[4] == pytest.approx(1 - np.prod([1 - s for *_, s in found]))
    assert toxicity.fit([("a. b. c.", 1)] * 2).scores(pa.array(["a. b. c. d."] * 2)) == pytest.approx([0.999] * 2)


def test_toxicity_held_out(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.digest(d, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.9
    again = toxicity.digest(d, labels.where(~toxicity.held_out(labels.doc_id)))
    assert sorted(map(tuple, again.select("doc_id", "score").collect())) == sorted(map(tuple, toxicity.digest(d, labels).select("doc_id", "score").collect()))


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(2, 0, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some_labels in (labels, labels.limit(0)):
        rows = toxicity.digest(clashing(docs(spark)), some_labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.digest(docs(spark, []), labels).count() == 0


# Media


def test_media_digest(spark):
    rows = media.digest(clashing(docs(spark))).collect()
    assert len(rows) == len(ROWS)
    texts = {r[0]: (r[1] or "").encode() for r in ROWS}
    for r in rows:
        t = texts[r.doc_id]
        payload = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes and re.fullmatch("[0-9a-f]{16}", r.feature)
    assert len({r.media_sha256 for r in rows if r.doc_id in (7, 8)}) == 1
    assert media.digest(docs(spark, [])).count() == 0


def brute_feature(payload):
    """The difference hash from exact sums: each pixel counts by the share of it in a thumbnail's rectangle."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)

    def shares(n, of):
        out = np.zeros((n, of))
        for k in range(n):
            lo, hi = k * of / n, (k + 1) * of / n
            for x in range(int(lo), min(of, math.ceil(hi))):
                out[k, x] = max(0.0, min(hi, x + 1) - max(lo, x))
        return out

    small = shares(8, len(a)) @ a @ shares(9, 64).T / (len(a) * 64 / 72)
    bits = [small[r, c + 1] - small[r, c] > 5e-7 for r in range(8) for c in range(8)]
    near = [abs(small[r, c + 1] - small[r, c]) < 2e-6 for r in range(8) for c in range(8)]
    return bits, near


def test_media_is_recomputed(spark):
    """Every reported value from the text itself, with the stored form made by numpy alone."""
    df = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(docs(spark), allowMissingColumns=True)
    texts = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in df.collect()}
    odd = 0
    for r in media.digest(df).collect():
        text = texts[r.doc_id, r.n_bytes]
        payload = text + b"\0" * ((-len(text)) % 64 if text else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        a, stored = np.frombuffer(payload, np.uint8).reshape(-1, 64), io.BytesIO()
        for k in range(0, len(a), 1024):
            np.lib.format.write_array(stored, a[k : k + 1024], version=(1, 0))
        assert (r.media_bytes, r.media_sha256, r.n_tiles) == (len(stored.getvalue()), hashlib.sha256(stored.getvalue()).hexdigest(), -(-len(a) // 1024))
        bits, near = brute_feature(payload)
        got = [int(r.feature, 16) >> (63 - k) & 1 for k in range(64)]
        assert all(g == b or n for g, b, n in zip(got, bits, near))
        odd += len(a) % 2
    assert 0 < odd < df.count()


def test_media_store_survives_anything(spark):
    head = lambda bits, used: struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + 4 * used, 40, 1, 1, 1, bits, 0, 0, 0, 0, used, 0)
    bad = [None, b"", b"P2 1 1 255 700", b"P3 1 1 9 1 2 10", b"P5 1 1 9\n\x0a", b"P2 1 1 255 x", b"P5 99999999 99999999 255\nx", head(8, 2) + b"\0" * 8 + b"\x05\0\0\0", b"BM" + b"\xff" * 60, b"P6 2"]
    rows = media.store(spark.createDataFrame(list(enumerate(bad)), "k int, img binary"), "k", "img").collect()
    assert len(rows) == len(bad) and all(r.error and r.tiles is None for r in rows)
    good = media.encode_bmp(np.arange(64, dtype=np.uint8).reshape(1, 64))
    assert media.decode(good)[:, :, 0].tolist() == [list(range(64))] and len(good) == 54 + 1024 + 64


def test_media_formats(spark):
    bits = np.array([[0, 255, 0], [255, 0, 255]])
    p1, p4 = b"P1\n# note\n3 2\n1 0 1\n0 1 0\n", b"P4 3 2\n" + bytes([0b10100000, 0b01000000])
    assert (media.decode(p1) == bits).all() and (media.decode(p4) == bits).all()
    assert media.decode(b"P2 2 1 70 # x\n7 70").tolist() == [[7, 70]] and media.decode(b"P3 1 2 255 1 2 3 4 5 6").tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    assert media.decode(b"P6 1 1 255\nabc").tolist() == [[[97, 98, 99]]] and media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    head = lambda w, h, bits, start=54: b"BM" + b"\0" * 8 + start.to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little", signed=True) + b"\1\0" + bits.to_bytes(2, "little") + b"\0" * 24
    assert media.decode(head(1, 2, 24) + b"\1\2\3\0" + b"\4\5\6\0").tolist() == [[[6, 5, 4]], [[3, 2, 1]]]
    assert media.decode(head(1, -2, 24) + b"\1\2\3\0" + b"\4\5\6\0").tolist() == [[[3, 2, 1]], [[6, 5, 4]]]
    assert media.decode(head(2, 1, 1, 62) + b"\0\0\0\0\xff\xee\xdd\0" + b"\x40\0\0\0").tolist() == [[[0, 0, 0], [0xDD, 0xEE, 0xFF]]]
    df = spark.createDataFrame([(1, bytearray(p1)), (2, None), (3, bytearray(b"P5 9 9 255\nxx"))], "k long, img binary")
    rows = {r.k: r for r in media.store(df, "k", "img", (2, 2)).collect()}
    assert rows[1].height == 2 and rows[1].tiles and rows[2].error and rows[3].error and rows[3].tiles is None


@settings(max_examples=60, deadline=None)
@given(some.integers(1, 30), some.integers(1, 30), some.integers(1, 9), some.integers(1, 9), some.integers(0, 99))
def test_resize_and_tiles(h, w, to_h, to_w, seed):
    a = np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)
    want = np.kron(a.astype(float), np.ones((to_h, to_w))).reshape(to_h, h, to_w, w).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(a, to_h, to_w), want)
    assert np.allclose(media.area_resize(a, to_h, to_w, band=3), want)
    assert (media.from_tiles(b"".join(media.to_tiles(a, (7, 5))), w) == a).all()


# HTML


def test_html_layout():
    page = """<html><head><title>x</title><style>p{}</style></head><body><p>Hello <b>bold</b>
 world<p>second<br>line<ul><li>one<li>two<ol start=3><li>a<li>b</ol><li>three</ul><div hidden>no</div><div style="display:none">no</div>
<table><caption>Cap</caption><tr><th>Name<th align=right>Qty<tr><td>Apple<td align=right>10<tr><td colspan=2>a long spanning cell<tr><td rowspan=2>X<td>1<tr><td>2</table>tail
<pre>
 keep   this
   too</pre><dl><dt>T<dd>D</dl><details><summary>S</summary>hid</details> &amp; &copy; 1 &lt; 2<script>var a="</p>";</script></body>"""
    assert html_text.to_text(page).split("\n") == [
        "Hello bold world", "", "second", "line", "", "- one", "- two", "  3. a", "  4. b", "- three", "", "Cap", "Name   Qty", "Apple   10", "a long spanning cell",
        "X      1", "       2", "", "tail", "", " keep   this", "   too", "", "T", "  D", "", "S", "& © 1 < 2",
    ]


def test_html_broken_pages():
    t = html_text.to_text
    assert t(None) == t("") == t("<a href='x") == "" and t("plain & <") == "plain & <" and t("a<!-- x") == "a"
    assert t("<table>stray<tr><td>c</table>") == "stray\n\nc" and t('<p title="a>b">q</p>') == "q" and t("<td>x</td>") == "x"
    assert t("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep" and t("<ul><li>a<ul><li>b</ul><li>c</ul>") == "- a\n  - b\n- c"


def tokens(page):
    """The standard's tokeniser, state by state: ("text", s), ("start", name, attributes) and ("end", name)."""
    space, out, at, n = " \t\n\f\r", [], 0, len(page)
    text = ""
    while at < n:
        c = page[at]
        after = page[at + 1 : at + 2]
        if c != "<" or not (after.isascii() and after.isalpha() or after and after in "!?/"):
            text += c
            at += 1
            continue
        if after == "/" and not (page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha()) or after in "!?":
            if at + 2 >= n and after == "/":
                text += "</"
                break
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        ends, at = after == "/", at + 1 + (after == "/")
        name, attrs, key, value, state = "", {}, "", "", "tag name"
        done = False

        def keep():
            if key:
                attrs.setdefault(key.lower(), value)

        while at < n and not done:
            c = page[at]
            at += 1
            if state == "tag name":
                if c in space or c == "/":
                    state = "before name"
                elif c == ">":
                    done = True
                else:
                    name += c
            elif state == "before name":
                if c == ">":
                    done = True
                elif c not in space and c != "/":
                    key, value, state = c, "", "name"
            elif state == "name":
                if c == "=":
                    state = "before value"
                elif c in space:
                    state = "after name"
                elif c in "/>":
                    keep()
                    state, done = "before name", c == ">"
                else:
                    key += c
            elif state == "after name":
                if c == "=":
                    state = "before value"
                elif c in "/>":
                    keep()
                    state, done = "before name", c == ">"
                elif c not in space:
                    keep()
                    key, value, state = c, "", "name"
            elif state == "before value":
                if c in "\"'":
                    state = c
                elif c == ">":
                    keep()
                    done = True
                elif c not in space:
                    value, state = c, "unquoted"
            elif state == "unquoted":
                if c in space or c == ">":
                    keep()
                    state, done = "before name", c == ">"
                else:
                    value += c
            elif c == state:  # the closing quote
                keep()
                state = "before name"
            else:
                value += c
        if text:
            out.append(("text", text))
            text = ""
        if done:
            out.append(("end", name.lower()) if ends else ("start", name.lower(), attrs))
    return [*out, ("text", text)] if text else out


@settings(max_examples=400, deadline=None)
@given(some.text(alphabet="<>/=\"' abP!\n", max_size=40))
def test_html_tags_by_state(tail):
    """Attributes and where tags end, against the standard's states. An open tag at the page's end is none."""
    page = "<i" + tail
    found, at = [], 0
    for m in html_text._TAG.finditer(page):
        if m[3] is not None and m[5] == ">":
            found.append(("end", m[3].lower()) if m[2] else ("start", m[3].lower(), html_text.Node("x", m[4]).attributes()))
    assert found == [t for t in tokens(page) if t[0] != "text"]


PARTS = "<p> </p> <table> <tr> <td> <th> </table> <ul> <li> </ul> <b> </b> <pre> </pre> <tbody> <caption> </td> </tr> <select> <option> <h1> </h2> <br> <dl> <dd> <dt> < &lt; <a ' \" > = /> title=don't <div> </div> <ol> </ol> {}".split()


@settings(max_examples=300, deadline=None)
@given(some.lists(some.sampled_from(PARTS + [f"word{k}" for k in range(5)]), max_size=40))
def test_html_loses_no_words(parts):
    """All words that the standard's tokeniser takes for text are in the result, quotes and open tags included."""
    page = ""
    for n, p in enumerate(parts):
        page += f" {p}x{n} " if p.startswith("word") else f"{p} " if p == "<a" else p
    words = sorted(w for t in tokens(page) if t[0] == "text" for w in re.findall(r"word\d+x\d+", t[1]))
    assert sorted(re.findall(r"word\d+x\d+", html_text.to_text(page))) == words


def test_html_quotes_and_spans():
    t = html_text.to_text
    assert t("<a title=don't>hello</a> world") == "hello world" and t('<p>a</p><img alt=5" src=x>rest of page') == "a\n\nrest of page"
    assert t("a<!-->b<!--->c<!-- > -->d") == "abcd" and t("<p hidden=\"\" hidden>x</p><p class='a'id=b>y") == "y"
    assert html_text.Node("a", " b='1' B=2 c = 3/ d").attributes() == {"b": "1", "c": "3/", "d": ""}
    rows = "".join(f"<tr><td>r{k}" for k in range(1, 1200))
    long = t(f"<table><tr><td rowspan=1150>x<td>r0{rows}</table>").split("\n")
    assert long[0] == "x      r0" and long[1149] == "       r1149" and long[1150] == "r1150"
    assert t("<table><tbody><tr><td rowspan=0>x<td>a<tr><td>b<tbody><tr><td>c<td>d</table>").split("\n") == ["x  a", "   b", "c  d"]
    assert t("<table><tr><td rowspan=9>x<td>a<tbody><tr><td>c<td>d</table>").split("\n") == ["x  a", "c  d"]


def test_html_head_without_end():
    t = html_text.to_text
    assert t("<html><head><title>t</title><body><p>text") == "text"
    assert t("<head><meta charset=utf-8><title>t</title><p>text<p>more") == "text\n\nmore"
    assert t("<head><title>t</title>\n <script>var a</script> plain <b>bold</b>") == "plain bold"
    assert t("<!doctype html><head><link href=x><style>p{}</style><noscript>n</noscript><title>t</title>") == ""


@pytest.mark.parametrize("depth", [150, *range(190, 211)])
def test_html_tables_at_the_depth_limit(depth):
    t = html_text.to_text
    for part in ("<table>", "<table><tbody>", "<table><thead><tr><th>h<tbody>", "<table><caption>h</caption>"):
        page = "<div>" * depth + f"{part}<tr><td>x1<td>y2<tr><td>z3<table><tr><td>i4<td>j5</table>k6</table>tail<script>var a</script><p hidden>no"
        assert t(page).replace("h", "", 1).split() == ["x1", "y2", "z3", "i4", "j5", "k6", "tail"]
    assert t("<table><tr><td>" * depth + "a<td>b" + "</table>" * depth + "c").split() == ["a", "b", "c"]


def test_html_forms_and_column_groups_in_tables():
    t = html_text.to_text
    assert t("<table><form>Search for <b>books</b><tr><td>c</form></table>") == "Search for books\n\nc"
    assert t("<table><tr><form><p>q</p><input value=v><td>c<td>d</table>e") == "q\n\nv\n\nc  d\n\ne"
    assert t("<table><colgroup><col>lost<tr><td>c</table>") == t("<table><colgroup>lost<tr><td>c</table>") == "lost\n\nc"
    assert t("<table><colgroup><b>bold</b><tbody><tr><td>c</table>") == "bold\n\nc" and t("<form>a<table><tr><td>c</table>b</form>") == "a\n\nc\n\nb"
    table = html_text.parse("<table><tr><td>c</table>").children[0]
    table.children.insert(0, "left over")
    assert html_text._table(table) == ["left over", "c"]


def test_html_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = html_text.extract(clashing(pages)).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) and "<script" not in r.text for r in rows)
    odd = spark.createDataFrame([(1, None), (None, "<p>a</p>"), (1, None)], "page_id long, html string")
    assert sorted((r.text for r in html_text.extract(odd).collect())) == ["", "", "a"]
    assert html_text.extract(odd.limit(0)).count() == 0
