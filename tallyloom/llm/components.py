"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``; ``root`` is the smallest node reachable.

    A large star links each node's larger neighbours to the smallest neighbour; a small star does so with the
    smaller ones. Together they halve the longest path, so the rounds grow with its logarithm. Each round is a
    written table of at most as many links; the loop ends when a round changes nothing. Null nodes and loops
    are left out. The result reads the last round's table, its ``work_table``.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "links",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v"), "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").select("u", "v").distinct(), "links")
        dropped(edges, large)
        new = _mark(after)
        edges = after
        if new == mark:
            break
        mark = new
    rooted = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    out = rooted.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out.work_table = edges.work_table
    return out


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
