"""Token ids, packing and token files."""

import functools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from streamtable.llm import packing, rans
from streamtable.llm.common import work_dir
from streamtable.llm.tokens import Encoder, default_vocabulary, slices
from tests.conftest import DATA
from tests.llm.fixtures import ROWS, clashing, docs

ODD = ["", None, "  ", "a<|endoftext|>b <|startoftext|> x", "ÀÉ ıİ ſ ǅ Σς ΑΣ é ́x", "don't I'LL'D 's '' 1234 ½ ª x y z　w \x1c \x85 漢字 \U0001f600", "﻿x​y A×B÷C", "ŉ ǰ İSTANBUL ß ẞ", "a\x00b", "x\ny\n\n'z.'"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder.get(default_vocabulary())


@functools.cache
def ids_of(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_are_the_librarys(encoder, spark):
    texts = ODD + [r[1] for r in ROWS] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    ids, starts = encoder.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == ids_of(encoder, t)
    empty, at = encoder.encode(pa.array([], pa.string()))
    assert len(empty) == 0 and at.tolist() == [0]


def test_other_vocabularies(spark):
    """Files that normalise or split otherwise go through the library as a whole; too many ids are refused."""
    path = default_vocabulary().replace("word_bpe_49k", "byte_bpe_50k")
    own = Encoder.get(path)
    assert Encoder.get(default_vocabulary()).known_form and not own.known_form
    texts = ODD + [r[1] for r in ROWS if r[0] != 10]
    ids, starts = own.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
    assert len(own.encode(pa.array([], pa.string()))[0]) == 0
    got = {(r.doc_id, r.start): r for r in packing.pieces(docs(spark, ROWS[:6]), path).collect()}
    assert all(got[r[0], 0].ids_crc32 == crc(own.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in ROWS[:6])


def test_too_many_ids(tmp_path):
    import json

    x = json.loads(open(default_vocabulary()).read())
    x["model"]["vocab"] |= {f"own{k}": 50_000 + k for k in range(16_500)}
    (tmp_path / "v.json").write_text(json.dumps(x))
    with pytest.raises(ValueError, match="65,535"):
        Encoder(str(tmp_path / "v.json"))


def test_forgetting(encoder, monkeypatch):
    monkeypatch.setattr("streamtable.llm.tokens.CACHE_PIECES", 50)
    for part in ("alpha beta gamma " * 3, " ".join(f"w{k}x" for k in range(80)), "alpha again"):
        ids, _ = encoder.encode(pa.array([part]))
        assert ids.tolist() == ids_of(encoder, part)
    encoder._forget()


def test_random_words(encoder):
    rng = random.Random(5)
    alphabet = "abzAZ09'.,!-_éßÉİıŉ×ªΣ漢́<|>t s"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    ids, starts = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == ids_of(encoder, t), t


def test_slices():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 100, "c", "d" * 5])})
    assert [s.num_rows for s in slices(batch, "text", 12)] == [2, 1, 2]


def test_patterns():
    rng = random.Random(1)
    for _ in range(200):
        h = {rng.randint(1, rng.choice([50, 2048])): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
        packed = packing.patterns(h)
        placed = Counter()
        for pattern, n in packed:
            assert sum(pattern) <= 2048 and n > 0
            for length in pattern:
                placed[length] += n
        assert placed == h
    assert packing.patterns({}) == []
    # Longest first, into the shortest pack.
    assert packing.patterns({1500: 1, 1000: 1, 500: 1}) == [((1500,), 1), ((1000, 500), 1)]


def one_by_one(histogram, most):
    """Each piece into the pack with the most room, the smallest pattern among equals."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [k for k, p in enumerate(packs) if most - sum(p) >= length]
            if fits:
                packs[min(fits, key=lambda k: (sum(packs[k]), packs[k]))] += (length,)
            else:
                packs.append((length,))
    return sorted(Counter(packs).items(), reverse=True)


def test_patterns_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        most = rng.choice([7, 16, 50])
        h = {rng.randint(1, most): rng.randint(1, 12) for _ in range(rng.randint(1, 12))}
        assert packing.patterns(h, most) == one_by_one(h, most)


@pytest.mark.parametrize("which", ["real", "odd", "empty"])
def test_packing(spark, encoder, which):
    df = spark.read.parquet(f"{DATA}/documents.parquet") if which == "real" else clashing(docs(spark, ROWS if which == "odd" else []))
    rows = packing.digest(df).collect()
    texts = Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    want = Counter()
    for (i, t), n in texts.items():
        ids = ids_of(encoder, t)
        for a in range(0, len(ids), 2048):
            want[i, a, min(2048, len(ids) - a), crc(ids[a : a + 2048]), len(ids)] += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    if which == "real":
        used = [sum(n for _, n in p) for p in sequences.values()]
        assert sum(2048 - n for n in used) < 0.03 * 2048 * len(used)


def test_sequences(spark, encoder):
    df = docs(spark, [r for r in ROWS if r[0] not in (8,)])
    texts = {r[0]: r[1] for r in ROWS}
    for r in packing.sequences(df).collect():
        ids = np.frombuffer(r.ids, "<u4")
        for p in r.pieces:
            assert ids[p.offset : p.offset + p.length].tolist() == ids_of(encoder, texts[p.doc_id])[p.start : p.start + p.length]


def test_decoding_from_checkpoints():
    rng = np.random.default_rng(7)
    ids = (rng.zipf(1.3, 200_000) % 49000).astype(np.uint16)
    table = rans.Table.from_counts(np.bincount(ids, minlength=1 << 16))
    segment = rans.encode_segment(ids, table)
    assert rans.segment_bytes(memoryview(segment)) == (len(ids), len(segment))
    for a, b in [(0, 1), (5, 70), (0, 200_000), (199_999, 200_000), (65_536, 65_537), (65_535, 131_073), (100_000, 150_000)]:
        assert (rans.decode_range(memoryview(segment), table, a, b) == ids[a:b]).all()
    sizes = np.array([10, 300_000, 0, 5, 250_000])
    many = (rng.zipf(1.3, int(sizes.sum())) % 49000).astype(np.uint16)
    table = rans.Table.from_counts(np.bincount(many, minlength=1 << 16))
    block, at = rans.encode_block([1, 2, None, 4, 5], sizes, many, table), np.cumsum(sizes) - sizes
    for k, got in rans.decode_documents(block, table, {1, 2, 4, 5, 9}):
        i = [1, 2, None, 4, 5].index(k)
        assert (got == many[at[i] : at[i] + sizes[i]]).all()


def test_lookup(spark, encoder):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    root = work_dir(spark, "lookup")
    rans.write(df, f"{root}/files", root=root)
    texts = {r.doc_id: r.text for r in df.collect()}
    wanted = [i for i in texts if i % 37 == 0] + [10**9]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rans.lookup(spark, f"{root}/files", wanted).collect()}
    assert got == {i: ids_of(encoder, texts[i]) for i in wanted if i in texts}
    assert rans.lookup(spark, f"{root}/files", []).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 70_000, 300_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49000).astype(np.uint16)
    table = rans.Table.from_counts(np.bincount(ids, minlength=1 << 16))
    assert table.freq.sum() == 1 << 20
    block = rans.encode_block([3, None], np.array([n - n // 2, n // 2]), ids, table)
    keys, sizes, back = rans.decode_block(block, table)
    assert keys == [3, None] and sizes.tolist() == [n - n // 2, n // 2] and (back == ids).all()
    broken = bytearray(block)
    broken[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), table)
    part = ids[: rans.SEGMENT]
    data = memoryview(rans.encode_segment(part, table))
    lanes = rans.LANES if len(part) >= 64 * rans.LANES else 0
    for k in range(1, 1 + (len(part) // lanes - 1) // rans.CHECKPOINT if lanes else 1):
        assert (rans.decode_segment(data, table, k)[0] == part[k * rans.CHECKPOINT * lanes :]).all()


def test_rare_ids_in_the_table():
    counts = np.zeros(1 << 16, np.int64)
    counts[:49000] = 1
    counts[7] = 10**12
    table = rans.Table.from_counts(counts)
    assert table.freq.sum() == 1 << 20 and (table.freq[:49000] > 0).all()
    ids = np.array([7, 48999, 3] * 100, np.uint16)
    assert (rans.decode_segment(memoryview(rans.encode_segment(ids, table)), table)[0] == ids).all()


@pytest.mark.parametrize("which", ["real", "odd", "empty"])
def test_token_files(spark, encoder, which, tmp_path):
    df = spark.read.parquet(f"{DATA}/documents.parquet") if which == "real" else clashing(docs(spark, ROWS if which == "odd" else []))
    want, start = [], 0
    for i, t in sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = ids_of(encoder, t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rans.digest(df).collect()), key=repr) == sorted(want, key=repr)
    rans.write(df, str(tmp_path / "files"))
    for r in rans.read(spark, str(tmp_path / "files"), with_ids=True).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32
