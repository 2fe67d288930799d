"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's odds are logistic in the sum of its words' weights, taken relative to a sentence
without any evidence, which so adds nothing: 1 - p = (1 - sigmoid(s + b)) / (1 - sigmoid(b)). A document's score is the noisy-or of
its sentences' and of one bias for the whole document: 1 - (1 - sigmoid(b)) * product of (1 - p). So length alone never makes a
document toxic. Only documents have labels; the gradient reaches the sentences through the noisy-or, so
the model learns which sentences offend and can point at them. Features are a word and its first letters, so that inflected and
unseen forms of a stem are found; a feature must speak for toxicity on its own to be taken up.

Fitting takes a bounded sample: of each class the MAX_ROWS labelled rows with the smallest hash, of texts up to MAX_CHARS, as far as
MAX_TOTAL characters of the class go. Executors turn their texts into hashed features, and the driver fits on those arrays, some ten
million numbers at most. Scores are computed for every document over its whole text. Rows whose crc32(id as text) mod 3 is 1 are
never learned from.

Defined cases: a null or empty text has one empty sentence and so the lowest score; null labels are ignored, several labels of one
id count as toxic if any is; without both classes all weights are zero and every score is the sample's share of toxic rows (0.5
without any row); null ids are scored and are not held out; repeated rows count once in the sample, and of rows with one hash the
smaller text hash comes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamtable.llm.common import map_arrow
from streamtable.llm.tokens import slices

MAX_ROWS = 2000
MAX_CHARS = 200_000
#: Characters of one class's sample: about ten million features for both classes, 80 MB.
MAX_TOTAL = 8_000_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
#: How many standard deviations a feature must be more frequent in toxic documents.
EVIDENCE = 2.0
STEPS = 200
RATE = 0.1
#: Pull of a weight to zero: what fewer documents than about DECAY * 2 of their class speak for is not learned.
DECAY = 7e-4
#: Stands for a line's end among the words.
BREAK = "\x1e"
CACHE_WORDS = 400_000
_STOP = re.compile(r"[.!?]\W*$")
_STRIP = re.compile(r"^\W+|\W+$")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@functools.lru_cache(maxsize=200_000)
def features(word: str) -> list[int]:
    """The hashes of a word and its beginnings; none for what has no letters."""
    w = _STRIP.sub("", word).lower()
    if not w:
        return []
    return [xxhash.xxh3_64_intdigest(x) for x in (w, *(f"{w[:k]}*" for k in PREFIXES if len(w) >= k))]


Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str | None) -> Bag:
    """A text as the numbers of features of its sentences, and all their features in a row."""
    own = _BLANK.sentences(text)
    found = [[f for w in text[a:b].split() for f in features(w)] for a, b, _ in own]
    return np.array([len(x) for x in found] or [0], np.int64), np.array([f for x in found for f in x], np.uint64)


@dataclass
class Model:
    """Weights by feature and the bias of a document."""

    bias: float
    weights: dict[int, float]
    _known: dict[str, tuple[float, bool]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "_known": {}}

    def word(self, word: str) -> tuple[float, bool]:
        """A word's weight, and whether a sentence ends behind it."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= CACHE_WORDS:
                self._known.clear()
            get = self.weights.get
            found = self._known[word] = (sum(get(f, 0.0) for f in features(word)), word == BREAK or word[-1:] in ".!?" or bool(_STOP.search(word)))
        return found

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score for each text."""
        n = len(texts)
        words = _words(texts)
        bounds = np.asarray(words.offsets) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        known = [self.word(w) for w in coded.dictionary.to_pylist()]
        codes = np.asarray(coded.indices)
        weight = np.array([k[0] for k in known])[codes] if len(codes) else np.zeros(0)
        ends = np.array([k[1] for k in known], bool)[codes] if len(codes) else np.zeros(0, bool)
        # Every text has one sentence at least; a sentence also starts with each text.
        new = np.concatenate(([False], ends[:-1])) if len(ends) else ends
        sentence = np.cumsum(new) if len(new) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        sentence = sentence + doc
        total = np.bincount(sentence, weight, minlength=int(sentence[-1]) + 1 if len(sentence) else 0)
        of = np.zeros(len(total), np.int64)
        of[sentence] = doc
        used = np.zeros(len(total), bool)
        used[sentence] = True
        base = np.logaddexp(0, self.bias)
        quiet = base - np.logaddexp(0, total[used] + self.bias)  # log of 1 - p
        return -np.expm1(np.bincount(of[used], quiet, minlength=n) - base)

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence, as places in the text. The document's bias is spread evenly over its sentences."""
        out, start, total, seen = [], None, 0.0, 0
        for m in re.finditer(r"[^\x20\x09-\x0D]+|\n", text or ""):
            if m[0] != "\n":
                weight, end = self.word(m[0])
                start, total, seen = m.start() if start is None else start, total + weight, m.end()
            if start is not None and (m[0] == "\n" or end):
                out.append((start, seen, total))
                start, total = None, 0.0
        if start is not None:
            out.append((start, seen, total))
        base = np.logaddexp(0, self.bias)
        return [(a, b, float(-np.expm1(base - base / len(out) - np.logaddexp(0, s + self.bias)))) for a, b, s in out]


def _words(texts: pa.Array) -> pa.ListArray:
    marked = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", f" {BREAK} ")
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(marked)) if len(texts) else pc.ascii_split_whitespace(marked)


_BLANK = Model(0.0, {})


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS, most_chars: int = MAX_TOTAL) -> list[tuple[Bag, int]]:
    """(bag, toxic) of at most `most` rows and `most_chars` characters of each class, never of held-out ids."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("y"))
    draw = F.xxhash64(F.lit("toxicity"), "doc_id")
    ids = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).select("doc_id", "y", draw.alias("draw")).orderBy("draw").limit(most)
        ids = own if ids is None else ids.unionByName(own)
    # 2 * most rows of three numbers.
    ids = ids.select(F.col("doc_id").alias("_id"), "y", "draw")
    rows = docs.select("doc_id", "text").where(F.length("text") <= MAX_CHARS).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    rows = rows.select("y", "draw", F.xxhash64("text").alias("hash"), F.length("text").alias("n"), "text")
    keys = rows.select("y", "draw", "hash", "n").distinct().orderBy("draw", "hash").limit(2 * most)
    upto = F.sum("n").over(Window.partitionBy("y").orderBy("draw", "hash"))  # of 2 * most rows
    keys = [tuple(r) for r in keys.select("draw", "hash", upto.alias("upto")).where(F.col("upto") <= most_chars).select("draw", "hash").collect()]
    if not keys:
        return []

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bag(x.as_py()) for x in batch.column("text")]
            columns = [pa.array([x[k].tobytes() for x in parts], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("draw", "hash", "y")), *columns], names=["draw", "hash", "y", "sizes", "features"])

    chosen = F.broadcast(docs.sparkSession.createDataFrame(keys, "draw long, hash long"))
    found = map_arrow(rows.join(chosen, ["draw", "hash"]).select("draw", "hash", "y", "text"), bags, "draw bigint, hash bigint, y bigint, sizes binary, features binary")
    once = {(r.draw, r.hash): r for r in found.toLocalIterator()}
    return [((np.frombuffer(r.sizes, np.int64), np.frombuffer(r.features, np.uint64)), int(r.y)) for _, r in sorted(once.items())]


class Problem:
    """The sample in arrays: which features each sentence has and which document each sentence belongs to."""

    def __init__(self, rows: list[tuple[Bag, int]]):
        self.y = np.array([t for _, t in rows], np.float64)
        self.n_pos, self.n_neg = int(self.y.sum()), int(len(self.y) - self.y.sum())
        n = len(rows)
        self.doc = np.repeat(np.arange(n), [len(b[0]) for b, _ in rows]) if n else np.zeros(0, np.int64)
        sizes = np.concatenate([b[0] for b, _ in rows]) if n else np.zeros(0, np.int64)
        sent = np.repeat(np.arange(len(sizes)), sizes)
        self.names, feat = np.unique(np.concatenate([b[1] for b, _ in rows]) if n else np.zeros(0, np.uint64), return_inverse=True)
        if not self.n_pos or not self.n_neg:
            self.sent = self.feat = np.zeros(0, np.int64)
            return
        # Documents of each class that a feature is in, and those features that speak for toxicity on their own.
        once = np.unique(feat * n + self.doc[sent])
        toxic = self.y[once % n] == 1
        in_pos, in_neg = (np.bincount(once[x] // n, minlength=len(self.names)) for x in (toxic, ~toxic))
        ratio = self.n_pos / self.n_neg
        with np.errstate(invalid="ignore", divide="ignore"):
            keep = (in_pos > 0) & ((in_pos - in_neg * ratio) / np.sqrt(in_pos + in_neg * ratio * ratio) >= EVIDENCE)
        number = np.cumsum(keep) - 1
        self.names, used = self.names[keep], keep[feat]
        self.sent, self.feat = sent[used], number[feat[used]]

    def loss(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Cross-entropy of the classes at equal weight, with the pull to zero, and its gradient, through the noisy-or; w: weights, then the bias."""
        s = w[-1] + np.bincount(self.sent, w[self.feat], minlength=len(self.doc))
        p, idle = 1 / (1 + np.exp(-s)), 1 / (1 + np.exp(-w[-1]))
        base = np.logaddexp(0, w[-1])
        log_none = np.bincount(self.doc, base - np.logaddexp(0, s), minlength=len(self.y)) - base
        whole = np.clip(-np.expm1(log_none), 1e-9, 1)
        value = (-(self.y * np.log(whole)).sum() / self.n_pos - ((1 - self.y) * log_none).sum() / self.n_neg) / 2 + DECAY * w[:-1].sum()
        pull = np.where(self.y == 1, -(1 - whole) / whole / self.n_pos, 1 / self.n_neg) / 2
        g_s = pull[self.doc] * p
        # The bias counts once a document, and in a sentence only as far as its evidence shifts it.
        g = np.append(np.bincount(self.feat, g_s[self.sent], minlength=len(self.names)), (pull[self.doc] * (p - idle)).sum() + (pull * idle).sum())
        g[:-1] += DECAY
        return float(value), g


def fit(rows: list[tuple[Bag | str, int]], steps: int = STEPS) -> Model:
    """Learn from (bag or text, toxic) rows. Runs on the driver, as the rows are bounded."""
    problem = Problem([(bag(x) if isinstance(x, str) else x, t) for x, t in rows])
    if not problem.n_pos or not problem.n_neg:
        share = min(max(float(problem.y.mean()) if len(problem.y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), {})
    w, m, v = (np.zeros(len(problem.names) + 1) for _ in range(3))
    w[-1] = -4.0
    for t in range(1, steps + 1):
        _, g = problem.loss(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return Model(float(w[-1]), {f: x for f, x in zip(problem.names.tolist(), w.tolist()) if x > 1e-3})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = np.clip(model.scores(part.column("text")), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], names=["doc_id", "score"])

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, start, end, sentence and its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [(i, a, b, t[a:b], s) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for a, b, s in model.sentences(t) if s >= least]
                columns = list(zip(*out)) or [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "sentence", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, start int, `end` int, sentence string, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs, fit(sample(docs, labels)))
