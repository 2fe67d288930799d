"""Quality rules, line dedup, mixing and sharding against their SQL and brute force, with edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from streamtable.llm import hilbert, line_dedup, mixing, quality_rules
from streamtable.llm.common import work_dir
from tests.conftest import DATA
from tests.llm.fixtures import ROWS, clashing, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def same(df, sql, path=f"{DATA}/documents.parquet"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    other = con.execute(sql)
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows, cols: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows), key=repr)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(other.fetchall(), names)


@pytest.mark.parametrize("module", [quality_rules, line_dedup, mixing, hilbert])
def test_against_sql(real, module):
    same(module.digest(real), module.oracle())


@pytest.mark.parametrize("module", [quality_rules, line_dedup, mixing, hilbert])
def test_edge_cases_against_sql(spark, tmp_path, module):
    rows = [r for r in ROWS if r[0] is not None or module is not line_dedup]
    path = str(tmp_path / "d.parquet")
    docs(spark, rows).coalesce(1).write.parquet(path)
    same(module.digest(clashing(spark.read.parquet(path))), module.oracle(), f"{path}/*.parquet")


@pytest.mark.parametrize("module", [quality_rules, line_dedup, mixing, hilbert])
def test_empty(real, module):
    assert module.digest(real.limit(0)).count() == 0
    assert module.digest(clashing(real.limit(0))).count() == 0


def measures(t):
    w = WORD.findall(t or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_brute_force(spark, real, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 20)
    for df in (real, docs(spark)):
        texts = defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append(r.text)
        for r in quality_rules.digest(df).collect():
            m = measures(texts[r.doc_id][0])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
            assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
            assert not (r.base_failed and r.kept)


def test_rules_exact_way(spark, monkeypatch):
    """So few hash bits that most windows collide: the exact way gives the same."""
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 61)
    df = docs(spark, [(k, " ".join(f"w{(i * i) % 37}" for i in range(80 + k)), "en", "a", 0) for k in range(5)])
    for r in quality_rules.digest(df).collect():
        text = " ".join(f"w{(i * i) % 37}" for i in range(80 + r.doc_id))
        assert r.n_repeat_words == measures(text)[4]


def test_ledger_policies_and_ablations(real):
    entries = quality_rules.stored(real)
    rows = entries.collect()
    for df in (quality_rules.ablations(entries), entries.where(quality_rules.verdict())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "xxhash64" not in plan and "regexp" not in plan.lower()  # no rule is evaluated again
    for policy, names in quality_rules.POLICIES.items():
        bits = quality_rules.mask(names)
        found = {r.rule: r for r in quality_rules.ablations(entries, policy).collect()}
        for name in names:
            bit = quality_rules.BIT[name]
            assert found[name].failed == sum(bool(r.fail_bits & bit) for r in rows)
            assert found[name].failed_alone == sum(r.fail_bits & bits == bit for r in rows)
            assert found[name].kept_without == sum(not r.fail_bits & bits & ~bit for r in rows)
        kept = quality_rules.keep(real, policy)
        assert kept.columns == real.columns
        assert kept.count() == sum(not r.fail_bits & quality_rules.mask({*names, *quality_rules.BASE}) for r in rows)


def test_good_documents_are_kept(spark, real):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    both = quality_rules.digest(real).join(labels, "doc_id").where("NOT base_failed")
    assert both.where("quality = 1 AND NOT kept").count() == 0
    assert both.where("quality = 0 AND kept").count() <= 1


def key(line):
    s = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def test_lines_brute_force(spark):
    held = defaultdict(set)
    for i, t, *_ in ROWS:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    for r in line_dedup.digest(docs(spark)).collect():
        t = next(x[1] for x in ROWS if x[0] == r.doc_id)
        lines = (t or "").split("\n")
        stays = [x for x in lines if len(held[key(x)]) < 3 or max(held[key(x)], key=lambda v: -1 if v is None else v) == r.doc_id]
        assert (r.n_lines, r.n_dropped) == (len(lines), len(lines) - len(stays))
        assert r.kept_sha256 == hashlib.sha256("\n".join(stays).encode()).hexdigest()


def test_runs_levels_and_stream(spark):
    state = line_dedup.LineRuns(spark, work_dir(spark, "runs"), fanout=2)
    seen = set()
    for b in range(5):
        rows = [(100 * b + k, f"a line that is long enough {k % 3 if k < 4 else 10 * b + k}", "en", "a", 0) for k in range(6)]
        lines = line_dedup.line_table(docs(spark, rows))
        got = {r.doc_id for r in line_dedup.survivors(lines, state).collect()}
        last = {t: i for i, t, *_ in rows}
        assert got == {i for t, i in last.items() if t not in seen}
        seen |= set(last)
    assert [len(level) for level in state.levels] == [1, 0, 1]
    runs = [{(r.h1, r.h2) for r in run.collect()} for run in state.runs()]
    assert sum(map(len, runs)) == len(set.union(*runs)) == len(seen)
    plan = state.fresh(line_dedup.line_table(docs(spark)).select("h1", "h2").distinct())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 2 and plan.count("Bucketed: true") == 2


def test_runs_decide(real, monkeypatch):
    """Without the anti-join no key of a later batch is known to be a repeat, and lines that must go stay."""
    right = {r.doc_id: r.n_dropped for r in line_dedup.digest(real).collect()}
    monkeypatch.setattr(line_dedup.LineRuns, "fresh", lambda self, keys: keys)
    wrong = {r.doc_id: r.n_dropped for r in line_dedup.digest(real).collect()}
    assert sum(wrong.values()) < sum(right.values())


def test_clean_keeps_columns(spark):
    out = line_dedup.clean(clashing(docs(spark)))
    assert out.columns == clashing(docs(spark)).columns
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[4] == "one two three\n\nfour" and by_id[1] is None and by_id[2] == ""


def fill(sizes, weights, most):
    """Water-filling by repeated clamping."""
    total, clamped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in clamped)
        free = [k for k in range(len(sizes)) if k not in clamped]
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k for k in free if share[k] > most * sizes[k]}
        if not over:
            return [most * sizes[k] if k in clamped else share[k] for k in range(len(sizes))]
        clamped |= over


@pytest.mark.parametrize("sizes", [[10, 1000, 5, 70], [100], [1, 1, 1000], [5, 0, 7, 3000, 2, 9], [50, 50, 50]])
def test_targets(spark, sizes):
    names = [chr(97 + k) for k in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    for n, want in zip(names, fill(sizes, [k % 3 + 1 for k in range(len(sizes))], 3)):
        assert got[n] == pytest.approx(want)


def test_mix(spark, real):
    rows = mixing.digest(clashing(docs(spark))).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.taken == r.size * r.n_copies and 0 <= r.taken <= 3 * r.size
    first, again = (sorted(map(tuple, mixing.digest(real).collect())) for _ in range(2))
    assert first == again
    taken = real.sparkSession.createDataFrame(mixing.digest(real).collect())
    for r in taken.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most
    mixed = mixing.mix(clashing(real))
    assert mixed.columns == clashing(real).columns
    assert mixed.count() == taken.agg(F.sum("n_copies")).first()[0]


def test_curve(spark):
    cells = [r.cell for r in hilbert.curve(spark).orderBy("place").collect()]
    assert sorted(cells) == list(range(32**3))
    point = lambda c: (c // 1024, c // 32 % 32, c % 32)
    assert all(sum(abs(x - y) for x, y in zip(point(a), point(b))) == 1 for a, b in zip(cells, cells[1:]))


def test_shards(spark, real, tmp_path):
    for df in (real, clashing(docs(spark))):
        rows = hilbert.digest(df).collect()
        counts = Counter(r.shard for r in rows)
        n = [counts[k] for k in range(24)]
        assert max(n) - min(n) <= 1 and sum(n) == df.count()
        for k in range(24):
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))
        texts = defaultdict(set)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].add(zlib.crc32((r.text or "").encode()))
        assert all(r.text_crc32 in texts[r.doc_id] for r in rows)
    hilbert.write(clashing(docs(spark)), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and set(clashing(docs(spark)).columns) < set(back.columns)


def test_written_shards_are_pruned(spark, real, tmp_path):
    """A filter on a dimension meets few shards: a shard holds a narrow range of each."""
    hilbert.write(real, str(tmp_path / "out"), 24)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(real.columns).collect()), key=repr) == sorted(map(tuple, real.collect()), key=repr)
    ranges = {r.shard_id: r for r in back.groupBy("shard_id").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.min("lang").alias("c"), F.max("lang").alias("d")).collect()}
    sources = [r.source for r in real.select("source").distinct().collect()]
    met = sum(r.a is not None and r.a <= s <= r.b for s in sources if s is not None for r in ranges.values())
    assert met <= 0.5 * len(ranges) * len(sources)
    assert back.where(F.col("lang") == "de")._jdf.queryExecution().executedPlan().toString().count("EqualTo(lang,de)") == 1
