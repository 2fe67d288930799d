import hashlib
from collections import Counter

import corpus_pipeline
from streamtable.llm import packing
from tests.conftest import DATA
from tests.llm.fixtures import ROWS, clashing, docs


def test_stages(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    own = df.columns
    before = {r.doc_id: r for r in df.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "packing"]
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        df = apply(spark, df, DATA)
        path = str(tmp_path / str(k))
        df.write.parquet(path)
        df = spark.read.parquet(path)
        if k < 4:
            assert df.columns == own
        rows = df.collect()
        if name in ("quality_rules", "near_dedup"):
            assert all(r == before[r.doc_id] for r in rows) and 0 < len(rows) < len(before)
        if name == "line_dedup":
            assert all(set(r.text.split("\n")) <= set(before[r.doc_id].text.split("\n")) for r in rows)
        if name == "source_mixing":
            assert all(r == before[r.doc_id] for r in rows) and max(Counter(r.doc_id for r in rows).values()) > 1
            mixed = Counter(r.doc_id for r in rows)
        if name == "packing":
            assert Counter(r.doc_id for r in rows if r.start == 0) == mixed
        before = {r.doc_id: r for r in rows}


def test_run_is_reproducible(spark):
    digest = lambda: hashlib.sha256(repr(sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "start", "length", "ids_crc32").collect()))).encode()).hexdigest()
    assert digest() == digest()


def test_edge_rows(spark):
    for rows in (ROWS, []):
        df = clashing(docs(spark, rows))
        for _, apply in corpus_pipeline.STAGES[:-1]:
            assert apply(spark, df, DATA).columns == df.columns
            apply(spark, df, DATA).count()
        assert packing.digest(df).count() >= len(rows)
