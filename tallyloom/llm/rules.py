"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit for each
rule; a policy is a version and a mask of the rules it enforces, so applying another version, or asking what
each rule alone costs (an ablation), only reads the ledger's bits.

Edge cases: a null or empty text has no words, fails ``too_few_words`` and keeps all other counts at zero;
rows with the same id are separate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACES, bind, table, text_of, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _at_least_twice(w: Column) -> Column:
    """Words of ``w`` inside windows of ``WINDOW`` words that stand in the text twice or more.

    Windows are named by a 64-bit hash of the words. Only where a name repeats are (name, place) pairs sorted,
    to find the places of repeated names; then the union of their windows is measured from the gaps.
    """
    names = F.transform(
        F.sequence(F.lit(0), F.size(w) - F.lit(WINDOW)),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
    )

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda i, j: F.get(p, i)["x"] == F.get(p, j)["x"]
            kept = F.filter(p, lambda e, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.array_sort(F.transform(kept, lambda e: e["i"]))

        def total(q: Column) -> Column:
            gaps = F.transform(q, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return bind(bind(pairs, places), total)

    repeats = bind(names, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(repeats)


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long)."""
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return (
        docs.select("doc_id", text_of().alias("_t"))
        .select(
            "doc_id",
            F.char_length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
            bind(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _at_least_twice(w).alias("n_repeat_words"))).alias("_w"),
        )
        .select("doc_id", "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_l.n_lines", "_w.n_repeat_words")
    )


#: Rules in order of their bits: name and failure condition over the measurements. New rules go at the end.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repetitive", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("symbol_heavy", "n_symbols > 0.1 * word_chars"),
    ("duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    ("very_long", "n_words > 100000"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that are enforced."""

    version: str
    enforced: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(n) for n in self.enforced)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", ("too_few_words", "repetitive")),
        Policy("v1", ("too_few_words", "repetitive", "short_words", "long_words", "symbol_heavy", "duplicate_lines")),
    )
}
CURRENT = POLICIES["v1"]


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, a long whose bit i says that rule i failed."""
    bits = None
    for i, (_, condition) in enumerate(RULES):
        bit = F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measurements(docs).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """A ledger with ``kept`` and ``policy`` for one version."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0).withColumn("policy", F.lit(policy.version))


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each enforced rule: how many documents fail it, how many fail it alone (dropping the rule keeps
    them), and how many all rules keep. The ledger is first counted by its bits, at most 2**rules rows."""
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if policy.mask >> i & 1]
    bit = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules])).alias("r")
    return counts.select("bits", "n", bit).groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fail"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("fail_alone"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("kept"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"].mask)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 7), ' ')) AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 9)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), c AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id
), b AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, n_repeat_words FROM m
), f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 8 ELSE 0 END
    + CASE WHEN n_symbols > 0.1 * word_chars THEN 16 ELSE 0 END + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN n_words > 100000 THEN 64 ELSE 0 END)::BIGINT AS failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept, failed
FROM f
"""
