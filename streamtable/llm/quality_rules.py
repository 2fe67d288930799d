"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger, a stored table, keeps the measurements and one bit for each failed
rule; policies are versioned sets of rules that are applied to the stored bits afterwards, and ablations are bitwise aggregates
over them. All of it is built-in expressions: one narrow pass over the text without any shuffle.

Defined cases: a null or empty text has no words and fails `few_words`; of a very long text all windows are held as one array of
longs; equal windows tie and are all counted; repeated rows give repeated ledger rows; an empty table gives an empty ledger; columns
of the input other than the id and the text are ignored or kept as they are, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamtable.llm.common import stage, whole, work_dir, words


@dataclass(frozen=True)
class Rule:
    """A named condition on the measurements. Bits are given by the place in RULES and never reused."""

    name: str
    fails: str
    why: str


RULES = (
    Rule("few_words", "n_words < 50", "too short to judge or to learn from"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", "more than half of the words lie in repeated 3-word windows"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "mean word length outside 2 to 14"),
    Rule("symbols", "10 * n_symbols > n_words", "more than one symbol for ten words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", "more than half of the lines repeat an earlier one"),
    Rule("upper_case", "10 * n_upper > 3 * n_letters", "more than 30 % of the letters are capitals"),
    Rule("few_letters", "10 * n_letters < 6 * word_chars", "fewer than 60 % of the characters are letters"),
    Rule("exclamations", "10 * n_exclaims > 2 * n_words", "more than one exclamation mark for five words"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}
#: The rules that fail every policy.
BASE = ("few_words", "repeated_words")
#: Versions are only ever added, so that a corpus can be rebuilt under the policy that made it.
POLICIES = {
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(BIT),
}
POLICY = "v2"
#: Bits of a packed window key that hold the window's position; longer documents take the exact way.
POSITION_BITS = 24


def mask(names) -> int:
    return sum(BIT[x] for x in names)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from `w`: words that lie in a 3-word window which the text holds twice or more.

    The window's hash and position share a long, so that sorting is a primitive sort; neighbours with one hash are compared by
    their words. Where two neighbours share the hash but not the words, the document is sorted by the words themselves.
    """
    low = (1 << POSITION_BITS) - 1
    n = F.size("w") - 2
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    window = lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))
    packed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: window(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    df = df.withColumn("s", F.when((n >= 2) & (n <= low), F.sort_array(packed)))
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    pair = F.zip_with(
        F.slice("s", F.lit(1), F.size("s") - 1),
        F.slice("s", F.lit(2), F.size("s") - 1),
        lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), POSITION_BITS) == 0, F.struct(at(a).alias("a"), at(b).alias("b"))),
    )
    df = df.withColumn("p", F.when(F.size("s") >= 2, F.filter(pair, lambda x: x.isNotNull())))
    same = lambda a, b: (F.get("w", a) == F.get("w", b)) & (F.get("w", a + 1) == F.get("w", b + 1)) & (F.get("w", a + 2) == F.get("w", b + 2))
    df = df.withColumn("exact", F.coalesce(n > low, F.lit(False)) | F.coalesce(F.exists("p", lambda x: ~same(x.a, x.b)), F.lit(False)))
    text = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    df = df.withColumn("x", F.when(F.col("exact"), F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(text(i).alias("t"), i.alias("i"))))))
    slow = F.filter(
        F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: F.when(a.t == b.t, F.struct(a.i.alias("a"), b.i.alias("b")))),
        lambda x: x.isNotNull(),
    )
    df = df.withColumn("p", F.when(F.col("exact"), slow).otherwise(F.col("p")))
    df = df.withColumn("q", F.when(F.size("p") > 0, F.sort_array(F.array_distinct(F.concat(F.transform("p", lambda x: x.a), F.transform("p", lambda x: x.b))))))
    steps = F.zip_with("q", F.slice("q", F.lit(2), F.greatest(F.size("q") - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("q") > 0, covered), F.lit(0)).cast("long")).drop("h", "s", "p", "x", "q", "exact")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and what the rules look at."""
    removed = lambda pattern: (F.length("t") - F.length(F.regexp_replace("t", pattern, ""))).cast("long")
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(F.col(id_col), whole(F.col(text_col)).alias("t")).select(id_col, "t", words(F.col("t")).alias("w"), lines.alias("l"))
    df = df.select(
        id_col,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        removed(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        removed(r"\p{Lu}+").alias("n_upper"),
        removed(r"\p{L}+").alias("n_letters"),
        removed("!+").alias("n_exclaims"),
    )
    df = _repeat_words(df).drop("w")
    # A generator in between, as a filter on a measurement would else be pushed down and written out through all these steps.
    return df.select(id_col, F.inline(F.array(F.struct(*(c for c in df.columns if c != id_col)))))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and fail_bits, with a bit of RULES set for each rule that the document fails."""
    bits = None
    for rule in RULES:
        bit = F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def stored(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, written below root and read again: policies and ablations over it evaluate no rule."""
    return stage(ledger(docs, id_col, text_col), f"{root or work_dir(docs.sparkSession, 'quality')}/ledger")


def verdict(policy: str = POLICY, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy, and no base rule, has failed."""
    return F.col(bits).bitwiseAND(F.lit(mask({*POLICIES[policy], *BASE}))) == 0


def ablations(entries: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: how many documents it fails, fails alone, and how many would stay without it.

    The ledger is first counted by its masked bits, at most 2**len(RULES) rows, so nothing of the corpus' size is moved.
    """
    names = POLICIES[policy]
    whole_mask = mask(names)
    counted = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole_mask)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(BIT[x]).cast("long").alias("bit")) for x in names)))
    flat = counted.select("b", "n", rules.alias("r")).select("b", "n", "r.rule", "r.bit")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    return flat.groupBy("rule").agg(
        total(F.col("b").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("b") == F.col("bit")).alias("failed_alone"),
        total(F.col("b").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )


def digest(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The contract's columns from the stored ledger."""
    return stored(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"),
        verdict(policy).alias("kept"),
        "n_lines", "n_upper", "n_letters", "n_exclaims", "fail_bits",
    )


def keep(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The documents that the policy keeps, with all their columns.

    The ledger's columns are made beside the document as one struct, so no join is needed and no name can clash. They aren't stored
    here, as that would store every document too; `stored` has the ledger alone.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("text").alias("t0"))
    return ledger(packed, "d", "t0").where(verdict(policy)).select("d.*")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    bits = " | ".join(f"(CASE WHEN {rule.fails} THEN {BIT[rule.name]} ELSE 0 END)" for rule in RULES)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{word}') AS w FROM d),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, x AS a, lead(x) OVER p AS b, lead(x, 2) OVER p AS c FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n >= 2) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
m AS (SELECT doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l.l)::BIGINT AS n_lines,
  (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
  (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::BIGINT AS n_letters,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask(BASE)}) <> 0 AS base_failed,
  (fail_bits & {mask({*POLICIES[POLICY], *BASE})}) = 0 AS kept, n_lines, n_upper, n_letters, n_exclaims, fail_bits
FROM b"""


__all__ = ["BASE", "BIT", "POLICIES", "POLICY", "RULES", "ablations", "digest", "keep", "ledger", "mask", "measure", "oracle", "stored", "verdict"]
