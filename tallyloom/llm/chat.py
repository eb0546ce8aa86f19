"""Chat formatting with cumulative-snapshot collapse.

A service that logs the whole conversation at every turn writes snapshots that are prefixes of later ones.
Each turn extends a rolling hash of the turns so far (128 bits: the exclusive or of two hashes of place, role
and text, so the prefix hash of a turn is a running aggregate). A conversation whose hash is the hash of a
proper prefix of a longer one is anti-joined away; of equal conversations the smallest conv_id stays. What
stays is rendered as one text. All steps are DataFrame operations; a conversation's turns meet in one task,
as its text is one value, and no other group does.

Edge cases: a null text is empty, a null role is ``unknown``; rows repeated in full count once; turns are in
order of turn (null last), role and text; null conv_ids make one conversation of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import table, text_of, written

#: How a turn is rendered: the role, then the text, then the end mark.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without repeats and nulls in role and text."""
    return conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), text_of().alias("text")
    ).distinct()


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, n_turns): the hash of the first ``place`` turns of each conversation."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("place", F.row_number().over(order))
    hashed = placed.select(
        "conv_id", "turn", "role", "text", "place",
        F.xxhash64("place", "role", "text").alias("x"), F.xxhash64(F.lit("second"), "place", "role", "text").alias("y"),
    )
    return hashed.select(
        "conv_id", "place", F.bit_xor("x").over(so_far).alias("a"), F.bit_xor("y").over(so_far).alias("b"),
        F.count(F.lit(1)).over(W.partitionBy("conv_id")).alias("n_turns"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, maximal): whether no longer conversation begins with this one."""
    hashed = written(prefixes(turns(conversations)), "chat-prefixes")
    whole = hashed.where("place = n_turns").select("conv_id", "n_turns", "a", "b")
    equal = whole.groupBy("a", "b", "n_turns").agg(F.min("conv_id").alias("least"))
    inner = hashed.where("place < n_turns").select("a", "b", F.col("place").cast("long").alias("n_turns")).distinct()
    stays = equal.join(inner, ["a", "b", "n_turns"], "left_anti").select("least", F.lit(True).alias("stays"))
    return whole.alias("w").join(stays.alias("s"), F.expr("w.conv_id <=> s.least"), "left").select("w.conv_id", "w.n_turns", F.coalesce("stays", F.lit(False)).alias("maximal"))


def render(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, maximal, and the rendered text (null if collapsed)."""
    kept = maximal(conversations)
    said = F.concat(F.lit(OPEN), F.col("role"), F.lit(MIDDLE), F.col("text"), F.lit(CLOSE))
    rows = turns(conversations).alias("t").join(kept.where("maximal").select("conv_id").alias("k"), F.expr("t.conv_id <=> k.conv_id")).select(
        "t.conv_id", F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text", said.alias("said")).alias("r")
    )
    texts = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["said"]), "").alias("rendered"))
    return kept.alias("k").join(texts.alias("x"), F.expr("k.conv_id <=> x.conv_id"), "left").select("k.*", "rendered")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = render(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "maximal", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, list(md5(role || chr(0) || text) ORDER BY turn NULLS LAST, role, text) AS h,
         string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS rendered
  FROM t GROUP BY conv_id
), k AS (
  SELECT *, array_to_string(h, '') AS k FROM c
), p AS (
  SELECT DISTINCT array_to_string(list_slice(h, 1, i), '') AS k FROM (SELECT h, unnest(generate_series(1, n_turns - 1)) AS i FROM c)
), m AS (
  SELECT k.*, k.k NOT IN (SELECT k FROM p) AND row_number() OVER (PARTITION BY k.k ORDER BY conv_id) = 1 AS maximal FROM k
)
SELECT conv_id, n_turns, maximal, CASE WHEN maximal THEN sha256(rendered) END AS rendered_sha256 FROM m
"""
