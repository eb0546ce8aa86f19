"""How filters interact: what each removes, in every order of applying them.

Every document becomes a mask of the filters it fails, and masks are counted: a cell is (part, mask) with its
documents, its good and its toxic ones, at most 2 ** filters cells a part. Cells are then unpivoted against the steps
of every order: one long row for each (cell, order, step). A running bit-or over the earlier steps of the order
says whether the cell was removed before, conditional sums give each step's figures, and a window over (part,
filter) totals what a filter removes in all orders. After the cells nothing grows with the documents.

The duplicate filter fails a text that a smaller ``doc_id`` has as well. Rows are first counted by the SHA-256 of
the text, so a group of copies, however large, shrinks to one row for each (part, mask, labels) before it is
compared with the smallest id of its text; no task sees the group.

Edge cases: a null text is an empty one, without words; a null source is the part ''; a row with a null id never
fails the duplicate filter, for no id is smaller than it, nor is it smaller than another; rows with the same id don't
fail each other and count each; a document counts as good or toxic if any of its label rows says so, and a document
without labels is neither; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import UPPER, bind, table, text_of, words, written

SYMBOLS = "#$%&*|"
DUPLICATE = "E"


def text_filters(text: Column) -> Column:
    """(words, distinct words, capitals, characters, symbols): what the filters A to D look at, in one struct."""
    return bind(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.char_length(text).cast("long").alias("n_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))).cast("long").alias("n_capitals"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        ),
    )


#: The filters that look at one text, by letter: the condition on ``m`` (``text_filters``) under which it fails.
FILTERS: dict[str, str] = {
    "A": "m.n_words < 200",
    "B": "100 * m.n_distinct < 50 * m.n_words",
    "C": "100 * m.n_capitals > 2 * m.n_chars",
    "D": "m.n_symbols > 0",
}


def _mask(filters: dict[str, str]) -> Column:
    bits = F.lit(0)
    for i, condition in enumerate(filters.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)))
    return bits


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail. Bit i of ``mask`` is the i-th of
    ``filters``; the next bit is the duplicate filter."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    t = text_of()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("name"), text_filters(t).alias("m"))
    rows = rows.select("doc_id", "part", "name", _mask(filters).alias("mask"))
    rows = rows.join(known, "doc_id", "left").select("doc_id", "part", "name", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    kinds = ["name", "part", "mask", "good", "toxic"]
    # The rows of one id are counted where the join has put them; ids are then told apart by min and min_by alone.
    ids = rows.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("named"),
        F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
    )
    groups = written(groups, "audit-groups")  # read twice below; the texts are read once
    copied = groups.groupBy("name").agg(F.min("first").alias("least"), F.sum("named").alias("all")).where("all > 1").drop("all")
    groups = groups.join(copied, "name", "left")
    failing = F.when(F.col("least").isNull(), F.lit(0)).otherwise(F.col("named") - F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(F.lit(0)))
    both = F.array(
        F.struct(F.col("mask"), (F.col("n") - failing).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask"), failing.alias("n")),
    )
    split = groups.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c) for c in ("good", "toxic")])


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of all ``letters`` and step: part, filter_order, step, filter, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley. Letter i is bit i of the cells' masks.

    The orders, letters! of them, are a constant that each cell's row is exploded with.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    long = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("_p", "filter"))
    bit = F.element_at(F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))]), F.col("filter"))
    long = long.withColumn("_bit", F.col("mask").bitwiseAND(bit))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.bit_or("_bit").over(before), F.lit(0)) != 0
    long = long.withColumn("_earlier", earlier)
    fails, gone = F.col("_bit") != 0, F.col("_earlier")
    total = lambda test, of="n": F.coalesce(F.sum(F.when(test, F.col(of))), F.lit(0)).cast("long")
    steps = long.groupBy("part", "filter_order", (F.col("_p") + 1).alias("step"), "filter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(fails & (F.col("mask") == F.col("_bit"))).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """The audit of ``filters`` and the duplicate filter over ``docs`` (doc_id, text, source), by source."""
    return audit(cells(docs, labels, filters), "".join(filters) + DUPLICATE)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id
), t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
      'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
      'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
      'E': coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)
    } AS f
  FROM t LEFT JOIN l USING (doc_id)
), x(c) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
  WHERE length(regexp_replace(a.c || b.c || c.c || d.c || e.c, 'A|B|C|D|E', '', 'g')) = 0
    AND a.c NOT IN (b.c, c.c, d.c, e.c) AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c
), s AS (
  SELECT filter_order, i::INTEGER AS step, substr(filter_order, i, 1) AS filter, substr(filter_order, 1, i - 1) AS before FROM o, range(1, 6) r(i)
), k AS (
  SELECT part, good, toxic, f['A'] AS a, f['B'] AS b, f['C'] AS c, f['D'] AS d, f['E'] AS e, f, count(*) AS n FROM m GROUP BY ALL
), g AS (
  SELECT part, filter_order, step, filter, n, good, toxic, f[filter] AS fails,
         len(list_filter(string_split(before, ''), lambda y: y <> '' AND f[y])) > 0 AS gone,
         a::INT + b::INT + c::INT + d::INT + e::INT = 1 AS only_one
  FROM k, s
), r AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND only_one), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM g GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
