"""The driver's tables in the roles of the model, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import table

#: Grades by pollster; one segment has none and gets the default. Weights by mode; one has none.
GRADES = (("AUTOMOBILE", 0.9), ("BUILDING", 0.8), ("FURNITURE", 0.7), ("HOUSEHOLD", 0.85))
MODES = {"1-URGENT": 1.0, "2-HIGH": 0.95, "3-MEDIUM": 0.8, "4-NOT SPECIFIED": 0.6}


def party(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    partner = F.when(k.isin(3, 24), F.lit(None)).otherwise(k.bitwiseXOR(F.lit(1))).cast("int")
    return table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.cast("int").alias("party_id"), F.col("n_name").alias("name"), F.col("r_name").alias("bloc"), k.cast("int").alias("ord"), partner.alias("partner")
    )


def poll(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    partial = F.col("o_orderstatus") == "P"
    return orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("pollster"),
        F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("provenance"),
        F.when(~partial, F.floor(F.col("o_totalprice") / 200)).cast("long").alias("sample_size"), partial.alias("partial"),
        (F.col("o_orderkey") % 17 == 0).alias("excluded"),
    )


def reading(spark: SparkSession, sf: str) -> DataFrame:
    lines, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    rows = lines.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.repartition("l_orderkey").groupBy(  # a poll's rows together, for what groups or joins by poll next
        F.col("l_orderkey").alias("poll_id"), F.col("s_nationkey").cast("int").alias("party_id")
    ).agg(F.sum("l_quantity").alias("seats"))


def grades(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(GRADES), "pollster string, grade double"))  # a row a pollster: polls stay where they are


def last_date(polls: DataFrame):
    """The newest date, as a literal column (one value)."""
    return F.lit(polls.agg(F.max("date")).first()[0])


PRELUDE = f"""
party AS (
  SELECT n_nationkey::INT AS party_id, n_name AS name, r_name AS bloc, n_nationkey::INT AS ord,
         CASE WHEN n_nationkey IN (3, 24) THEN NULL ELSE xor(n_nationkey, 1) END::INT AS partner
  FROM nation JOIN region ON n_regionkey = r_regionkey
), poll AS (
  SELECT o_orderkey AS id, o_orderdate::DATE AS date, c_mktsegment AS pollster, o_orderpriority AS mode, o_orderstatus AS provenance,
         CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 200) END::BIGINT AS sample_size, o_orderstatus = 'P' AS partial, o_orderkey % 17 = 0 AS excluded
  FROM orders JOIN customer ON o_custkey = c_custkey
), reading AS (
  SELECT l_orderkey AS poll_id, s_nationkey::INT AS party_id, sum(l_quantity) AS seats FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), grades(pollster, grade) AS (VALUES {", ".join(f"('{p}', {g}::DOUBLE)" for p, g in GRADES)}
), newest AS (SELECT max(date) AS d FROM poll
), weighed AS (
  SELECT p.*, pow(0.5, greatest(date_diff('day', p.date, a.d), 0) / 14.0) AS recency, least(1.0, coalesce(p.sample_size::DOUBLE, 450.0) / 1000.0) AS sample,
         coalesce(g.grade, 0.6::DOUBLE) AS quality,
         CASE p.mode {" ".join(f"WHEN '{m}' THEN {w}" for m, w in MODES.items())} ELSE 0.7 END::DOUBLE AS mode_weight,
         CASE WHEN p.partial THEN 0.75 ELSE 1.0 END::DOUBLE AS completeness
  FROM poll p CROSS JOIN newest a LEFT JOIN grades g ON p.pollster = g.pollster WHERE p.date <= a.d AND NOT p.excluded
), w AS (SELECT *, recency * sample * quality * mode_weight * completeness AS weight FROM weighed)
"""
