"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule. The weights share the words of the corpus between the sources; a
target stops at ``max_repeat`` times what its source holds, and the excess is shared again. The schedule says
how a source's share is spread over training time 0..1; its integral is the cumulative demand. A source's
documents stand in a fixed pseudo-random order (MD5 of the id), repeated. A copy that starts at word ``x`` of
that stream is taken while demand reaches it, and its training position is the time at which cumulative
demand is ``x``. Documents come out sorted by position, by range.

Prefix sums have two levels (buckets of the MD5 order, then within a bucket), so no task holds a source.

Edge cases: a null or empty text has size 0 and is never taken (taken 0, position null); a null source is a
source of its own, after all others; rows with the same id are separate documents, in the order of a 128-bit hash
of their texts, and null ids stand by that hash alone, so reruns agree in whatever order the rows come; rows with
the same id, source and text are alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import table, text_of, word_count, written

#: Weights and schedules of the sources in order of their names, repeating. A schedule is a list of
#: (time, relative rate) knots, linear between them.
WEIGHTS = (1, 2, 3)
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
MAX_REPEAT = 3
BUCKET_ROWS = 50_000


def text_name() -> Column:
    """A 128-bit hash of the text, which tells rows with the same id apart."""
    return F.md5(text_of().cast("binary"))


def segments(schedule) -> list[tuple[float, float, float, float, float]]:
    """(start time, width, rate at start, rate at end, share of demand before) with rates of integral 1."""
    area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(schedule, schedule[1:]))
    out, before = [], 0.0
    for (t0, a), (t1, b) in zip(schedule, schedule[1:]):
        out.append((t0, t1 - t0, a / area, b / area, before))
        before += (t1 - t0) * (a + b) / 2 / area
    return out


def time_of(share: Column, schedule) -> Column:
    """The time at which the cumulative demand of ``schedule`` is ``share``: each segment's integral is a
    quadratic, inverted in the form that is stable for a small slope."""
    out = None
    for t0, width, a, b, before in reversed(segments(schedule)):
        y = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * (b - a) / width) * y, F.lit(0.0)))
        t = F.lit(t0) + F.when(root + F.lit(a) > 0, F.lit(2.0) * y / (root + F.lit(a))).otherwise(F.lit(0.0))
        out = t if out is None else F.when(share < F.lit(later), t).otherwise(out)
        later = before
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size)`` -> with ``slot`` (0-based place in the cycle), ``weight`` and ``target``.

    Water-filling in closed form: with sources by size per weight, the k smallest are capped for the least k
    at which the level shared by the rest is not above the next cap. One row for each source.
    """
    names = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before = W.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(names) - 1).withColumn("slot", F.col("rank") % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("slot") + 1).cast("int")).cast("long"))
    left = F.sum("source_size").over(every) - max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (
        ranked.withColumn("_left", left).withColumn("_free", free)
        .withColumn("_ok", max_repeat * F.col("source_size") * F.col("_free") >= F.col("weight") * F.col("_left"))
        .withColumn("_level", F.min_by(F.when(F.col("_ok"), F.col("_left") / F.col("_free")), F.when(F.col("_ok"), F.struct(F.col("source_size") / F.col("weight"), "rank"))).over(every))
    )
    target = F.least((max_repeat * F.col("source_size")).cast("double"), F.col("weight") * F.col("_level"))
    return level.select("source", "source_size", "slot", "weight", F.round(target, 6).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row for each document: doc_id, name (of the text), source, size, source_size, target, positions (of the
    copies taken)."""
    sized = written(
        docs.select(
            F.col("doc_id"), text_name().alias("name"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), text_of()).cast("binary")).alias("key"),
        ),
        "mix-sizes",
    )
    rows = sized.count()
    digits = max(2, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS + 1, 16)))
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    start = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeat)
    offsets = per_bucket.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(start), F.lit(0))).drop("bucket_size")
    inner = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "name").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("d")
    known = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select("o.source", "bucket", "bucket_start", "source_size", "slot", "target")
    placed = placed.join(known.alias("k"), F.expr("d.source <=> k.source and d.bucket = k.bucket")).select(
        "doc_id", "name", "d.source", "size", "source_size", "slot", "target", (F.col("bucket_start") + F.col("inner")).alias("at")
    )

    def position(start: Column) -> Column:
        share = start / F.col("target")
        out = time_of(share, schedules[-1])
        for k, schedule in enumerate(schedules[:-1]):
            out = F.when(F.col("slot") % len(schedules) == k, time_of(share, schedule)).otherwise(out)
        return out

    starts = F.filter(
        F.array(*[F.col("at") + k * F.col("source_size") for k in range(max_repeat)]),
        lambda x: (F.col("size") > 0) & (2 * x + F.col("size") <= 2 * F.col("target")),
    )
    placed = placed.withColumn("starts", starts)
    return placed.select("doc_id", "name", "source", "size", "source_size", "target", F.transform("starts", position).alias("positions"))


def curriculum(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``plan`` range-sorted by the first position, documents that are not taken last."""
    placed = plan(docs, weights, schedules, max_repeat)
    return placed.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The documents as they are trained on: one row for each copy taken, range-sorted by position.

    Columns doc_id, text, lang, source, n_chars, copy (from 0), position. Rows alike in id, source and text are each
    one of the planned rows, so their copies are those of the plan in any order.
    """
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    key = ("doc_id", "source", "name")
    alike = plan(docs, weights, schedules, max_repeat).groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.count(F.lit(1)).alias("rows"))
    rows = docs.select(*columns, text_name().alias("name"))
    same = F.expr("d.doc_id <=> c.doc_id and d.name = c.name and cast(d.source as string) <=> c.source")
    single = rows.alias("d").join(alike.where("rows = 1").alias("c"), same).select(*[f"d.{c}" for c in columns], "positions")
    first = lambda c: F.min(F.struct(*[x for x in columns if x not in ("doc_id", "source")])).alias(c)
    many = rows.join(alike.where("rows > 1").select(*[F.col(c).alias(f"_{c}") for c in key], "positions"), F.expr("doc_id <=> _doc_id and name = _name and cast(source as string) <=> _source"))
    many = many.groupBy("doc_id", "source", "name").agg(first("r"), F.first("positions").alias("positions")).select("doc_id", "r.text", "r.lang", "source", "r.n_chars", "positions")
    return single.unionByName(many).select(*columns, F.posexplode("positions").alias("copy", "position")).orderBy("position", "doc_id", "copy")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("long").alias("taken"),
        F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position"),
    )


def _time_sql(schedule) -> str:
    out, later = "", 0.0
    for t0, width, a, b, before in reversed(segments(schedule)):
        y = f"greatest(share - {before!r}, 0.0)"
        root = f"sqrt(greatest({a * a!r} + {2 * (b - a) / width!r} * {y}, 0.0))"
        t = f"({t0!r} + CASE WHEN {root} + {a!r} > 0 THEN 2.0 * {y} / ({root} + {a!r}) ELSE 0.0 END)"
        out = t if not out else f"CASE WHEN share < {later!r} THEN {t} ELSE {out} END"
        later = before
    return out


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM d GROUP BY source
), w AS (
  SELECT *, (rnk % 3) + 1 AS wt FROM s
), f AS (
  SELECT *, sum(ss) OVER () - 3 * coalesce(sum(ss) OVER b, 0) AS lft, sum(wt) OVER () - coalesce(sum(wt) OVER b, 0) AS fre
  FROM w WINDOW b AS (ORDER BY ss::DOUBLE / wt, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT lft::DOUBLE / fre::DOUBLE AS level FROM f WHERE 3 * ss * fre >= wt * lft ORDER BY ss::DOUBLE / wt, rnk LIMIT 1
), t AS (
  SELECT source, ss, rnk, round(least((3 * ss)::DOUBLE, wt * level), 6) AS target FROM f, l
), o AS (
  SELECT doc_id, size, t.ss, t.rnk, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE (2 * pos + size <= 2 * target)::BIGINT + (2 * (pos + ss) + size <= 2 * target)::BIGINT
         + (2 * (pos + 2 * ss) + size <= 2 * target)::BIGINT END AS copies,
         CASE WHEN target > 0 THEN pos::DOUBLE / target END AS share FROM o
)
SELECT doc_id, size, ss AS source_size, target, (size * copies)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(CASE rnk % 3 WHEN 0 THEN {_time_sql(SCHEDULES[0])} WHEN 1 THEN {_time_sql(SCHEDULES[1])}
  ELSE {_time_sql(SCHEDULES[2])} END, 6) END AS first_position
FROM c
"""
